"""How filters act on each other in every order: a table-driven byte transducer measures, tables of failure masks count.

One pass over the UTF-8 bytes of a batch measures every text: a byte's class is looked up in a table, the class names the
state that follows (inside a word, or between words), and state and class look up what the byte puts out: it begins or ends a
word, is a capital, a symbol, a code point (bytes that continue one are not). White space is ASCII, so the state after a byte
depends on that byte alone and the whole batch takes the step at once. The spans that the pass puts out go into a hash
table of open addressing, keyed by text and word; a span that meets a span of its own hash is compared with it byte by byte.

Each document then is a mask of the filters it fails, and each part (language) a count for each of the 32 masks. What any
filter does at any step of any order is a sum over masks, so the documents are read once, whatever the number of orders.

Filter E (a copy of a text with a smaller key) groups digests of texts; digests that many documents share meet their
first key in a bounded broadcast (`looked_up`). Labels meet counts by (key, part, mask), so that a key that many
rows share is few rows there.

Defined cases. Null text is empty: it fails A, and E if an empty text has a smaller key; B and C compare 0 with 0 and
pass. Rows with a null key, or with the key that is the smallest of their text, are no copies; repeated rows are counted
as often as they occur. Null parts are the empty string. A key that any label row calls good (quality 1) or toxic counts as such; null
keys have no labels. Texts of any length are measured whole; bytes that are no UTF-8 belong to words. An empty table has no
parts and gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outline_jobs.llm.common import batches_of, looked_up, mixed, table, written

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 100, 80, 10
SYMBOLS = b"#$%&*|"
MASKS = 1 << len(FILTERS)
#: Bytes of text in one Arrow batch.
TEXT_BYTES = 1 << 22
#: Words of more bytes are hashed and compared one by one, not in columns of eight bytes.
LONG_WORD = 64

# The transducer. Classes of bytes:
_OTHER, _BLANK, _CAPITAL, _SYMBOL, _CONTINUED = range(5)
# States, and for each class the state after it:
_BETWEEN, _INSIDE = 0, 1
_NEXT = np.array([_INSIDE, _BETWEEN, _INSIDE, _INSIDE, _INSIDE], np.uint8)
# Outputs, as bits:
_BEGINS, _ENDS, _IS_CAPITAL, _IS_SYMBOL, _IS_POINT = 1, 2, 4, 8, 16


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = _BLANK
    out[ord("A") : ord("Z") + 1] = _CAPITAL
    out[list(SYMBOLS)] = _SYMBOL
    out[0x80:0xC0] = _CONTINUED
    return out


def _outputs() -> np.ndarray:
    """What a byte puts out, by state before it * 5 + class."""
    out = np.zeros((2, 5), np.uint8)
    out[:, _CAPITAL] |= _IS_CAPITAL
    out[:, _SYMBOL] |= _IS_SYMBOL
    out[:, :_CONTINUED] |= _IS_POINT
    out[_BETWEEN, _NEXT == _INSIDE] |= _BEGINS
    out[_INSIDE, _BLANK] |= _ENDS
    return out.ravel()


_CLASS, _OUTPUT = _classes(), _outputs()


def _eights(raw: np.ndarray, at: np.ndarray, left: np.ndarray, loads: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number, those beyond what is left of the word as 0."""
    cut = np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))
    return (loads[at] << cut) >> cut


def _span_hashes(raw: np.ndarray, loads: np.ndarray, start: np.ndarray, size: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A hash of text number, length and bytes of each span."""
    out = mixed(text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64))
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] ^= np.uint64(xxhash.xxh64_intdigest(raw[start[k] : start[k] + size[k]].data))
    short = np.flatnonzero(size <= LONG_WORD)
    for done in range(0, LONG_WORD, 8):
        short = short[size[short] > done]
        if not len(short):
            break
        out[short] = mixed(out[short] ^ _eights(raw, start[short] + done, size[short] - done, loads)) + np.uint64(done + 1)
    return mixed(out)


def _same(raw: np.ndarray, loads: np.ndarray, start: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of equal sizes from both places hold the same bytes."""
    out = np.ones(len(start), bool)
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = np.array_equal(raw[start[k] : start[k] + size[k]], raw[other[k] : other[k] + size[k]])
    short = np.flatnonzero(size <= LONG_WORD)
    for done in range(0, LONG_WORD, 8):
        short = short[(size[short] > done) & out[short]]
        if not len(short):
            break
        left = size[short] - done
        out[short] = _eights(raw, start[short] + done, left, loads) == _eights(raw, other[short] + done, left, loads)
    return out


def _first_spans(raw: np.ndarray, start: np.ndarray, size: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Marks one span of each word of each text: those that found a free slot of the table, not their own word in one."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    loads = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    codes = _span_hashes(raw, loads, start, size, text)
    slots = 1 << max(1, int(len(start) * 2).bit_length())
    owner = np.full(slots, -1, np.int64)
    first = np.zeros(len(start), bool)
    waiting = np.arange(len(start))
    slot = (codes & np.uint64(slots - 1)).astype(np.int64)
    while len(waiting):
        free = waiting[owner[slot[waiting]] < 0]
        owner[slot[free]] = free  # of several that come at once one is written
        found = owner[slot[waiting]]
        first[waiting[found == waiting]] = True
        alike = (found != waiting) & (codes[found] == codes[waiting]) & (text[found] == text[waiting]) & (size[found] == size[waiting])
        place = np.flatnonzero(alike)
        alike[place] = _same(raw, loads, start[waiting[place]], start[found[place]], size[waiting[place]])
        waiting = waiting[(found != waiting) & ~alike]
        slot[waiting] = (slot[waiting] + 1) & (slots - 1)
    return first


def measures(raw: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, symbols and code points of texts laid end to end in raw; ends is where each ends."""
    n = len(ends)
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    kind = _CLASS[raw]
    before = np.empty(len(raw), np.uint8)
    before[1:] = _NEXT[kind[:-1]]
    before[begins[begins < len(raw)]] = _BETWEEN  # each text begins between words
    out = _OUTPUT[before * np.uint8(5) + kind]

    def places(bit: int) -> np.ndarray:
        return np.flatnonzero(out & np.uint8(bit))

    def per_text(at: np.ndarray) -> np.ndarray:
        cuts = np.searchsorted(at, np.concatenate(([0], ends)))
        return cuts[1:] - cuts[:-1]

    start = places(_BEGINS)
    text = np.searchsorted(ends, start, "right")
    # A word ends at white space or with its text, whose last byte then lies inside a word.
    filled = ends[(ends > begins)]
    open_end = filled[_NEXT[kind[filled - 1]] == _INSIDE]
    stop = np.sort(np.concatenate((places(_ENDS), open_end)))
    first = _first_spans(raw, start, stop - start, text)
    return {
        "n_words": np.bincount(text, minlength=n), "n_distinct": np.bincount(text[first], minlength=n),
        "n_capitals": per_text(places(_IS_CAPITAL)), "n_symbols": per_text(places(_IS_SYMBOL)), "n_points": per_text(places(_IS_POINT)),
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("_text").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        raw = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, np.uint8)
        got = measures(raw, offsets[1:] - offsets[0]) if len(texts) else {}
        if got:
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("_key", "_part", "_digest")] + [pa.array(v, pa.int64()) for v in got.values()], ["_key", "_part", "_digest", *got]
            )


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """_key, _part, the five measures and _mask (bit k: fails filter k of FILTERS) of every row of docs."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("_key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"), F.unhex(F.sha2(body, 256)).alias("_digest"), body.alias("_text")
    )
    key_type = rows.schema["_key"].dataType.simpleString()
    schema = f"_key {key_type}, _part string, _digest binary, n_words long, n_distinct long, n_capitals long, n_symbols long, n_points long"
    with batches_of(docs.sparkSession, TEXT_BYTES):
        rows = written(rows.mapInArrow(_measured, schema), "audit-measures")
    groups = written(rows.groupBy("_digest").agg(F.min("_key").alias("_least"), F.count(F.lit(1)).alias("_n")), "audit-texts")
    rows = looked_up(rows, groups, ["_digest"], rows.count())
    fails = {
        "A": F.col("n_words") < MIN_WORDS,
        "B": F.col("n_distinct") * 100 < F.col("n_words") * MIN_DISTINCT_PERCENT,
        "C": F.col("n_capitals") * 100 > F.col("n_points") * MAX_CAPITAL_PERCENT,
        "D": F.col("n_symbols") > 0,
        "E": F.coalesce(F.col("_key") > F.col("_least"), F.lit(False)),
    }
    mask = sum((fails[f].cast("int") * (1 << k) for k, f in enumerate(FILTERS)), F.lit(0))
    return rows.withColumn("_mask", mask).drop("_digest", "_least")


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """For each _part, arrays n, good and toxic with the documents of each mask."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic")
    )
    keyed = failed.groupBy("_key", "_part", "_mask").agg(F.count(F.lit(1)).alias("_n"))
    keyed = keyed.join(marks.withColumnRenamed("doc_id", "_key"), "_key", "left")
    for c in ("_good", "_toxic"):
        keyed = keyed.withColumn(c, F.coalesce(F.col(c), F.lit(0)) * F.col("_n"))
    few = keyed.groupBy("_part", "_mask").agg(*[F.sum(c).alias(c) for c in ("_n", "_good", "_toxic")])

    def each(c: str) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("_mask") == m, F.col(c))), F.lit(0)) for m in range(MASKS)])

    return few.groupBy("_part").agg(each("_n").alias("n"), each("_good").alias("good"), each("_toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = mask_counts(failures(docs, **names), labels)
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = counts.select("*", F.explode(F.split(F.lit(" ".join(orders)), " ")).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = "transform(sequence(1, length(filter_order)), i -> shiftleft(1, ascii(substr(filter_order, i, 1)) - ascii('A')))"
    # Written, as Spark would otherwise compute both again for each of the sums below.
    steps = steps.withColumn("_bits", F.expr(bits)).withColumns({
        "_own": F.expr("_bits[step - 1]"), "_before": F.expr("aggregate(slice(_bits, 1, step - 1), 0, (a, b) -> a | b)"),
    })
    masks = f"filter(sequence(0, {MASKS - 1}), m -> {{}})"
    removed, redundant = "m & _own > 0 and m & _before = 0", "m & _own > 0 and m & _before > 0"

    def total(of: str, which: str) -> Column:
        return F.expr(f"aggregate({masks.format(which)}, 0L, (a, m) -> a + {of}[m])")

    steps = steps.select(
        F.col("_part").alias("part"), "filter_order", "step", "_own",
        total("n", "m & (_own | _before) = 0").alias("kept"), total("n", removed).alias("removed"), total("n", redundant).alias("redundant"),
        F.expr("n[_own]").alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
    )
    sums = steps.groupBy("part", "_own").agg(F.sum("removed").alias("shapley"))
    return written(steps, "audit-steps").join(sums, ["part", "_own"]).drop("_own")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


ORACLE = """
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
f AS (
    SELECT doc_id, part,
        len(words) < 100 AS a,
        100 * len(list_distinct(words)) < 80 * len(words) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
        regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
    FROM w
),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
    SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
        count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
),
orders(o) AS (
    SELECT '' UNION ALL SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(o) < 5 AND NOT contains(o, x)
),
s AS (
    SELECT o, step, (1 << (ascii(o[step]) - 65))::INT AS own,
        coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(o[i]) - 65))), 0)::INT AS earlier
    FROM (SELECT o, unnest(range(1, 6)) AS step FROM orders WHERE length(o) = 5)
),
r AS (
    SELECT part, o AS filter_order, step::INT AS step, own,
        coalesce(sum(n) FILTER (mask & (own | earlier) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
    FROM m, s GROUP BY ALL
)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""
