"""Product codes of vectors: codebooks fitted on all rows, distances read from tables over per-dimension dictionaries.

Components become integers, floor(256 * x), and a batch of vectors is dictionary-coded in each dimension: its distinct
integers, and a code for each row. The squared differences of every distinct integer to the component of every codebook entry are
tabulated once for the batch, so that the distances of a part to all entries are a gather of table rows by code and an add
for each dimension; no difference is computed twice. A dictionary has at most as many integers as the batch has rows.

Each round is one pass over the vectors: a task returns sums and counts for each dimension and entry, which Spark adds up.
What comes to the driver is a codebook's size (dimensions times entries), whatever the number of rows. All arithmetic is in
64-bit integers, so that the order of rows and tasks never changes a result.

Defined cases. Rows whose vector is null or holds a null or non-finite component are left out. Integers are kept within 2 ** 26 of 0
(components of up to 262,144 are exact). The number of dimensions is that of the kept vector with the smallest id; a vector of
another length stays in the result with a null code and error and takes no part in the codebooks. Dimensions that do not
divide by the parts are cut at floor(part * dimensions / parts). Null ids sort last; equal ids among the first entries
are ordered by their integers. Fewer vectors than entries give as many entries as there are vectors; an empty table gives no rows.
Ties go to the lower index. Repeated rows count as often as they occur. Equal labels, nulls together, share label_error;
labels that many rows share meet it in a bounded broadcast. Extra columns are kept,
those named as a result, in any case, as own_....
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outline_jobs.llm.common import apart, looked_up, packed, table, unpacked, written

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
LARGEST = 1 << 26
RESULTS = ("code", "error", "label_error", "codebooks_sha256")
#: Rows whose distances are held at once.
CHUNK = 4096


def integers(vectors: DataFrame, vector: str) -> DataFrame:
    """The kept rows of vectors with _ints, their components as integers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * SCALE))).cast("int"))
    return vectors.where(F.col(vector).isNotNull() & finite).withColumn("_ints", whole)


def bounds(dims: int, parts: int) -> list[int]:
    return [p * dims // parts for p in range(parts + 1)]


def dictionary(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct integers of a column in order, and each row's place among them."""
    low, high = int(column.min()), int(column.max())
    if high - low > 4 * len(column) + 1024:
        return np.unique(column, return_inverse=True)
    seen = np.zeros(high - low + 1, bool)
    seen[column - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[column - low]


def nearest(rows: np.ndarray, books: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part of each row, and the squared distances of the row's parts to them in all."""
    codes = np.zeros((len(rows), len(cuts) - 1), np.int64)
    error = np.zeros(len(rows), np.int64)
    coded = [dictionary(rows[:, d]) for d in range(rows.shape[1])]
    for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
        far = np.zeros((len(rows), len(books)), np.int64)
        for d in range(a, b):
            values, places = coded[d]
            squares = np.square(values[:, None] - books[None, :, d])
            far += squares[places]
        codes[:, p] = far.argmin(axis=1)  # the first of equal ones
        error += far[np.arange(len(rows)), codes[:, p]]
    return codes, error


def chunks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the batch with vectors of this length, and those vectors, some rows at a time."""
    column = batch.column("_ints")
    fits = np.flatnonzero(column.value_lengths().to_numpy(zero_copy_only=False) == dims)
    for i in range(0, len(fits), CHUNK):
        some = fits[i : i + CHUNK]
        yield some, column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(some), dims)


def moved(kept: DataFrame, books: np.ndarray, cuts: list[int]) -> np.ndarray:
    """The codebooks after one round: every entry the mean, rounded down, of the parts nearest to it; unused ones as they were."""
    entries, dims = books.shape
    part_of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((dims, entries), np.int64), np.zeros((dims, entries), np.int64)
        for batch in batches:
            for _, rows in chunks(batch, dims):
                codes, _ = nearest(rows, books, cuts)
                for d in range(dims):
                    mine = codes[:, part_of[d]]
                    np.add.at(total[d], mine, rows[:, d])
                    count[d] += np.bincount(mine, minlength=entries)
        used = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*used, total[used], count[used])], ["dim", "entry", "total", "n"])

    # Dimensions times entries rows, whatever the input.
    found = kept.select("_ints").mapInArrow(sums, "dim long, entry long, total long, n long").groupBy("dim", "entry").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    for r in found.collect():
        out[r["entry"], r["dim"]] = r["total"] // r["n"]
    return out


def fitted(kept: DataFrame, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, list[int]]:
    """(entries by dimensions, where parts begin and end) from rows with _ints; no entries for no rows. At most 256 entries: two hex digits."""
    if not 0 < entries <= 256:
        raise ValueError("between 1 and 256 entries")
    least = kept.select(F.col(key).alias("_key"), "_ints").orderBy(F.col("_key").asc_nulls_last(), "_ints")
    one = least.limit(1).collect()
    dims = len(one[0]["_ints"]) if one else 0
    first = least.where(F.size("_ints") == dims).limit(entries).collect() if one else []
    books, cuts = np.array([r["_ints"] for r in first], np.int64).reshape(len(first), dims), bounds(dims, parts)
    for _ in range(rounds if first else 0):
        books = moved(kept, books, cuts)
    return books, cuts


def digest(books: np.ndarray, cuts: list[int]) -> str:
    """SHA-256 of all components by part, entry and place within the part, in decimal, with commas."""
    numbers = (str(x) for a, b in zip(cuts, cuts[1:]) for entry in books for x in entry[a:b])
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def coded(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """The kept rows of vectors, without the vector itself, with code, error, label_error and codebooks_sha256."""
    others = [c for c in vectors.columns if c.lower() != vector.lower()]
    names = apart(vectors.select(*[F.col(f"`{c}`") for c in others]), RESULTS)[1]
    # The caller's columns travel as one, so that no working name meets theirs.
    rows = vectors.select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.col(vector).alias("_vector"), packed(vectors, (vector,)))
    kept = written(integers(rows, "_vector").drop("_vector"), "codes-integers")
    books, cuts = fitted(kept, "_key", parts, entries, rounds)
    dims = books.shape[1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.full(batch.num_rows, None, object), np.zeros(batch.num_rows, np.int64)
            for some, rows in chunks(batch, dims) if len(books) else ():
                found, error[some] = nearest(rows, books, cuts)
                hexed = found.astype(np.uint8).tobytes().hex()
                code[some] = [hexed[i : i + 2 * parts] for i in range(0, len(hexed), 2 * parts)]
            none = np.array([c is None for c in code], bool)
            own = [c for c in batch.schema.names if c != "_ints"]
            out = [batch.column(c) for c in own] + [pa.array(code, pa.string()), pa.array(error, pa.int64(), mask=none)]
            yield pa.RecordBatch.from_arrays(out, [*own, "_code", "_error"])

    schema = kept.drop("_ints").schema.add("_code", "string").add("_error", "long")
    rows = written(kept.mapInArrow(encode, schema), "codes-rows")
    rows = rows.withColumns({"_name": F.coalesce(F.col("_label").cast("string"), F.lit("")), "_none": F.col("_label").isNull()})
    sums = written(rows.groupBy("_name", "_none").agg(F.sum("_error").alias("_sum"), F.count(F.lit(1)).alias("_n")), "codes-labels")
    found = looked_up(rows, sums, ["_name", "_none"], rows.count())
    return found.select(
        *unpacked(others, names),
        F.col("_code").alias("code"), F.col("_error").alias("error"), F.col("_sum").alias("label_error"), F.lit(digest(books, cuts)).alias("codebooks_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).select("vec_id", *RESULTS)


def _oracle() -> str:
    """SQL with the two rounds spelled out; a part's components are rows of (part, place, x)."""
    out = """
WITH k AS (
    SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
u AS (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS d, len(v) // 16 AS w FROM k),
x AS MATERIALIZED (SELECT id, d // w AS part, d % w AS place, x FROM u),
b0 AS MATERIALIZED (
    SELECT e, part, place, x AS c FROM x JOIN (SELECT id, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM k) USING (id) WHERE e < 64
)"""
    for r in range(ROUNDS + 1):
        out += f""",
d{r} AS (SELECT id, part, e, sum((x - c) * (x - c))::BIGINT AS far FROM x JOIN b{r} USING (part, place) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT id, part, e, far FROM d{r} QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY far, e) = 1)"""
        if r < ROUNDS:
            out += f""",
s{r} AS (SELECT part, e, place, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (id, part) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (
    SELECT e, part, place, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM b{r} LEFT JOIN s{r} USING (part, e, place)
)"""
    return f"""{out},
codes AS (
    SELECT id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{ROUNDS} GROUP BY id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, e, place)) FROM b{ROUNDS}) AS codebooks_sha256
FROM codes JOIN k USING (id)
"""


ORACLE = _oracle()
