"""Shards that all hold the mixture of the whole: proportional stratified interleaving.

Native: DataFrame functions only. The rows of each source are put in a seeded random order (by a hash of the key) and
ranked from 0; a row's fractional rank is (rank + 0.5) / rows of its source. All rows are then sorted by fractional rank
and cut into `shards` runs of equal length, so that every run holds each source in the proportion of the whole, to within
a row or two, and each shard reads as the mixture from its first slot to its last.

Neither order is made in one task. Rows are range-partitioned, first by (source, hash), then by (fractional rank, source);
a row's place within its range is monotonically_increasing_id(), and how many rows lie in the ranges before it is a sum
over one row for each range (and source in it). A source of any size, a key or a text that a third of all rows share, is
thus spread over as many ranges as it fills. Both orders are total but for wholly equal rows, which are interchangeable,
so that reruns agree.

Defined cases. The law is `rows`: counts of any two shards differ by one at most; fewer rows than shards fill as many shards as
there are rows. Null text has the size 16 and the checksum of an empty one. Null sources are a source of their own. Rows
with one key or text are ordered by key, checksum and size; equal texts (groups of copies) are not held together. Texts of
any length only add to their size. Empty tables give empty results; extra columns are kept under their own names, those
named as a result, in any case, as own_....
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outline_jobs.llm.common import apart, table, written

SHARDS = 40
#: Bytes that a document takes besides its text.
OVERHEAD = 16
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Bits of monotonically_increasing_id() that count rows within a partition.
_ROW_BITS = 33


def shuffled_by(key: Column, seed: int) -> Column:
    """A long that depends on the key and the seed alone, the same in any engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def ordered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows range-partitioned and sorted by keys, written; _place grows along the order and counts by one within a _range."""
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    return written(ranged, name).withColumn("_range", F.shiftright("_place", _ROW_BITS))


def ranked(rows: DataFrame) -> DataFrame:
    """Rows with _source and _u -> and _rank, their place in the shuffled order of their source, and _of, the source's rows."""
    placed = ordered(rows, ["_source", "_u", "_key", "_crc", "_bytes", "_row_id"], "shard-sources")
    # One row for each range, and one more for each source that begins within a range.
    runs = placed.groupBy("_range", "_source").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("_source")
    before = F.sum("_n").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(
        F.col("_range").alias("_r"), F.col("_source").alias("_s"), "_first",
        F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("_of"),
    )
    runs = written(runs, "shard-runs")
    # No broadcast is asked for: Spark decides by the size of the written table.
    found = placed.join(runs, (F.col("_range") == F.col("_r")) & F.col("_source").eqNullSafe(F.col("_s")))
    return found.withColumn("_rank", F.col("_before") + F.col("_place") - F.col("_first")).drop("_place", "_range", "_r", "_s", "_first", "_before")


def interleaved(
    docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 13, texts: bool = False
) -> DataFrame:
    """All rows of docs, without their text unless asked for, with size, text_crc32, law, shard, slot and grown_shard (null).

    Without texts only the other columns are exchanged, twice; with them the texts are, too.
    """
    kept = [c for c in docs.columns if texts or c.lower() != text.lower()]
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(key).alias("_key"), F.col(source).alias("_source"), shuffled_by(F.col(key), seed).alias("_u"),
        F.crc32(body).alias("_crc"), (F.length(body) + OVERHEAD).cast("long").alias("_bytes"),
        # Only spreads wholly equal rows over ranges.
        F.monotonically_increasing_id().alias("_row_id"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_own"),
    )
    # Written once: choosing the borders of the ranges reads it again.
    mixed = ranked(written(rows, "shard-rows")).withColumn("_at", (F.col("_rank") + 0.5) / F.col("_of"))
    placed = ordered(mixed.drop("_u", "_key", "_row_id", "_of"), ["_at", "_source", "_rank"], "shard-mixture")
    # One row for each range.
    counts = placed.groupBy("_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(upto), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy())})
    found = placed.join(written(counts.drop("_n"), "shard-counts"), "_range")
    found = found.withColumn("_pos", F.col("_before") + F.col("_place") - F.col("_first"))
    found = found.withColumn("_shard", F.expr(f"_pos * {shards} div _all"))
    first = F.expr(f"(_shard * _all + {shards - 1}) div {shards}")
    names = apart(docs.select(*[F.col(f"`{c}`") for c in kept]), RESULTS)[1]
    return found.select(
        *[F.col(f"_own.`{c}`").alias(n) for c, n in zip(kept, names)],
        F.col("_bytes").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"), (F.col("_pos") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, **names: str) -> DataFrame:
    """Writes whole rows as Parquet under folder/shard=N, in the order of their slots, and returns them read back.

    A shard is as many files as ranges of (shard, slot) meet it; files are named in order of their ranges.
    """
    rows = interleaved(docs, shards, texts=True, **names)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return interleaved(docs).select("doc_id", *RESULTS)


#: The checksum is that of the reflected polynomial 0xEDB88320, a table of 256 entries and one step for each byte.
ORACLE = """
WITH RECURSIVE t(i, k, c) AS (
    SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS entries FROM t WHERE k = 8),
d AS (SELECT doc_id, source, encode(coalesce(text, '')) AS body FROM documents),
b AS (SELECT *, [4294967295::BIGINT] || list_transform(regexp_extract_all(hex(body), '..'), lambda y: ('0x' || y)::BIGINT) AS codes FROM d),
s AS (
    SELECT doc_id, source, octet_length(body) + 16 AS size, CAST('0x' || substr(md5('13:' || doc_id), 1, 15) AS BIGINT) AS u,
        xor(list_reduce(codes, lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
    FROM b, crc
),
r AS (
    SELECT *, count(*) OVER () AS n, row_number() OVER (PARTITION BY source ORDER BY u, doc_id) - 1 AS rank,
        count(*) OVER (PARTITION BY source) AS of_source FROM s
),
p AS (SELECT *, row_number() OVER (ORDER BY (rank + 0.5::DOUBLE) / of_source, source NULLS FIRST, rank) - 1 AS pos FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 40 // n)::INTEGER AS shard, pos - (pos * 40 // n * n + 39) // 40 AS slot,
    NULL::INTEGER AS grown_shard
FROM p
"""
