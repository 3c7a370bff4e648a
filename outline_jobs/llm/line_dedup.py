"""Lines that many documents repeat, dropped from all but the last document that holds them.

Native: DataFrame functions only. A line's key is the line without white space at its ends, A-Z lower-cased;
only keys of at least `min_chars` code points count. Key hashes (two of 64 bits) are range-partitioned together
with the document, so that a hash as common as a third of all lines is spread over many ranges, and
streamed in the order of hash, document, position. Within a range the number of documents of a key and its last
document are known at once; only keys that lie across a border between ranges need more, and of those there is
at most one for each border. Their totals are the one small table that is broadcast.

The operator returns no text: n_lines, n_dropped and the keep bitmap of each document, compressed as the runs of
dropped lines.

Defined cases. Null text is one empty line. Rows that share a doc_id are one document when documents are counted, and
each keeps or drops its own lines; wholly equal rows stay equal. A null doc_id is a document that sorts first. Empty tables give empty
results; extra columns are left out.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outline_jobs.llm.common import table, written


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\f\r")), string.ascii_uppercase, string.ascii_lowercase)


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, _tie (a hash of the text) and the sorted positions of the lines that go."""
    line = docs.select("doc_id", F.xxhash64("text").alias("_tie"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    key = line.select("doc_id", "_tie", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    # Written once: choosing the borders of the ranges reads it again.
    seen = written(key.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "_tie", "pos"), "line-hashes")
    ranged = seen.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "_tie", "pos")
    ranged = written(ranged.withColumn("_range", F.spark_partition_id()), "line-ranges")
    run = Window.partitionBy("_range", "h1", "h2")
    first = F.lag(F.struct("doc_id")).over(run.orderBy("doc_id", "_tie", "pos")).eqNullSafe(F.struct("doc_id"))
    streamed = ranged.withColumn("_new", (~first).cast("int"))
    streamed = streamed.withColumns({"_docs": F.sum("_new").over(run), "_last": F.max("doc_id").over(run), "_head": F.row_number().over(run.orderBy("doc_id", "_tie", "pos")) == 1})
    across = (
        ranged.groupBy("_range").agg(F.min(F.struct("h1", "h2")).alias("a"), F.max(F.struct("h1", "h2")).alias("b"))
        .select(F.explode(F.array("a", "b")).alias("k"), "_range").distinct()
        .groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k.h1", "k.h2")
    )
    # At most one key for each border between ranges.
    total = (
        ranged.join(F.broadcast(across), ["h1", "h2"], "left_semi").groupBy("h1", "h2")
        .agg(F.count_distinct(F.struct("doc_id")).alias("_all"), F.max("doc_id").alias("_end"))
    )
    known = streamed.join(F.broadcast(total), ["h1", "h2"], "left")
    many = F.coalesce("_all", "_docs") >= min_docs
    last = F.when(F.col("_all").isNotNull(), F.col("_end")).otherwise(F.col("_last"))
    gone = known.where(many & ~F.col("doc_id").eqNullSafe(last)).select("doc_id", "_tie", "pos")
    return gone.groupBy("doc_id", "_tie").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def runs(dropped: Column) -> Column:
    """Sorted positions -> the runs of neighbours, as structs of first and last."""
    heads = F.filter(dropped, lambda x, i: (i == 0) | (F.element_at(dropped, F.greatest(i, F.lit(1))) != x - 1))
    tails = F.filter(dropped, lambda x, i: (i == F.size(dropped) - 1) | (F.element_at(dropped, F.least(i + 2, F.size(dropped))) != x + 1))
    return F.zip_with(heads, tails, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, _tie, n_lines, n_dropped, keep_bitmap (runs of dropped lines; empty: all stay)."""
    gone = dropped_lines(docs, min_chars, min_docs)
    every = docs.select("doc_id", F.xxhash64("text").alias("_tie"), F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"))
    return _joined(every, gone).select("doc_id", "_tie", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), runs(F.col("dropped")).alias("keep_bitmap"))


def _joined(rows: DataFrame, gone: DataFrame) -> DataFrame:
    g = gone.select(F.col("doc_id").alias("_id"), F.col("_tie").alias("_t"), "dropped")
    out = rows.join(g, rows["doc_id"].eqNullSafe(g["_id"]) & (rows["_tie"] == g["_t"]), "left").drop("_id", "_t")
    return out.withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))


def apply_bitmap(text: Column, bitmap: Column) -> Column:
    """The text without the lines of the bitmap's runs."""
    lines = lines_of(text)
    gone = F.flatten(F.transform(bitmap, lambda r: F.sequence(r["first"], r["last"])))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.when(F.size(bitmap) == 0, F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.withColumn("_tie", F.xxhash64("text"))
    marked = _joined(rows, dropped_lines(docs)).withColumn("keep_bitmap", runs(F.col("dropped")))
    return marked.select(
        "doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"),
        F.sha2(F.encode(apply_bitmap(F.col("text"), F.col("keep_bitmap")), "UTF-8"), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT k.*, m.key IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN m USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id
"""
