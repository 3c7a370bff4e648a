"""Mixing sources to target weights by Pareto order sampling.

A source's target of words is shared out by weight and stops at `most` times its size. A document's expected copies are its source's
share (target / size of the source), leaned towards short documents: share + min(share, most - share) / 2 * (lean - mean lean of the source), where
lean = LEAN / (size + LEAN) and the mean is by words. The words expected are then exactly the target, and no document is expected more than
`most` times. The whole copies among them are certain; the rest, p, is drawn: each document has inclusion odds p / (1 - p) of its own, and random
odds u / (1 - u), u from a hash of its key. Documents are ranked by random odds over inclusion odds and the first are taken, up to the place
where the words taken come nearest to what the whole copies leave of the target.

The place is found without sorting a source in one task: ranks are counted in SPLIT bins per source, the bin
that holds the place is found from those sums, and only documents of that bin are counted in finer bins,
then sorted. Each level divides the rows by SPLIT, so a source of any size ends in a few rows.

Defined cases. Sizes of 0 (null or empty text, white space) take nothing and stay in the result with 0 copies. A null
source is a source of its own and sorts last. Repeated keys and equal ranks are ordered by a hash of the text;
wholly equal rows are interchangeable and drawn as separate rows where they fall on the border. Empty tables
give empty results; extra columns are kept, those named as a result is as own_... (mixed_documents keeps all names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outline_jobs.llm.common import SPACE, apart, packed, table, unpacked, written

#: Bins per source and level, and levels before the last sort.
SPLIT, LEVELS = 1024, 2
#: Words at which a document leans halfway; steps of the lean, which is a whole number so that its sums are exact.
LEAN, STEPS = 256, 1024
RESULTS = ("size", "source_size", "target", "copies", "taken")


def words(text: Column) -> Column:
    """Number of words; null: 0."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), rf"{SPACE}+", " ")
    return F.when(F.trim(kept) == "", 0).otherwise(F.size(F.split(F.trim(kept), " "))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """source, source_size -> and target. Sources in code point order, null last, take the weights in turn.

    The capped shares are min(most * size, level * weight) for one level. One row per source: small by its meaning.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = sizes.withColumn("_n", F.row_number().over(order) - 1)
    n = n.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights)).cast("int") + 1))
    by = Window.orderBy((most * F.col("source_size") / F.col("_w")).asc(), "_n")
    every = Window.partitionBy()
    level = n.withColumns({
        "_left": F.sum("source_size").over(every) - F.coalesce(F.sum(most * F.col("source_size")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_over": F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("_level", F.col("_left") / F.col("_over"))
    # The levels rise while sources are capped below their share and fall after that: the right one is the highest.
    found = level.withColumn("_found", F.max("_level").over(every))
    return found.select(*sizes.columns, F.least(most * F.col("source_size").cast("double"), F.coalesce("_found", F.lit(0.0)) * F.col("_w")).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and seed alone; 48 bits, the same in any engine."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, texts: bool = False) -> DataFrame:
    """All rows of docs, without their text unless asked for, with size, source_size, target, copies and taken (copies * size).

    With texts, the texts are read once more and not shuffled: what is decided is one border for each source.
    """
    own = [c for c in docs.columns if texts or c.lower() != text.lower()]
    names = apart(docs.select(*[f"`{c}`" for c in own]), RESULTS)[1]
    docs = docs.select(packed(docs, () if texts else (text,)), F.col(key).alias("_key"), F.col(source).alias("source"), F.col(text).alias("_text"))
    key, source, text = "_key", "source", "_text"
    lean = F.floor(F.lit(LEAN * STEPS) / (F.col("size") + LEAN))
    sized = docs.select("_row", key, source, words(F.col(text)).alias("size"), uniform(F.col(key), seed).alias("_u"), F.xxhash64(text).alias("_tie"))
    slim = written(sized.select(*dict.fromkeys((key, source, "size", "_u", "_tie"))) if texts else sized, "mix-sizes")
    sums = slim.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"), F.sum(lean * F.col("size")).alias("_lean"))
    goal = written(targets(sums, weights, most), "mix-targets")
    # One row for each source: broadcast only as far as Spark's own size limit for it allows.
    g = goal.withColumnRenamed("source", "_source")
    with_targets = lambda d: d.join(g, d[source].eqNullSafe(g["_source"]), "left").drop("_source")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    room = F.least(share, most - share) / 2
    expected = share + room * (lean - F.when(F.col("source_size") > 0, F.col("_lean") / F.col("source_size")).otherwise(0.0)) / STEPS
    rank = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))

    def ranked(d: DataFrame) -> DataFrame:
        d = with_targets(d).withColumn("_e", F.when(F.col("size") > 0, expected).otherwise(0.0)).withColumn("_whole", F.floor(F.col("_e") + 1e-12)).withColumn("_p", F.greatest(F.col("_e") - F.col("_whole"), F.lit(0.0)))
        # rank / (1 + rank) keeps the order and lies in (0, 1), so that it can be cut into bins.
        return d.withColumn("_rank", F.when(F.col("_p") > 0, rank)).withColumn("_place", F.col("_rank") / (1 + F.col("_rank")))

    rows = ranked(slim)
    sure = rows.groupBy(F.col(source).alias("_ns")).agg((F.max("target") - F.sum(F.col("_whole") * F.col("size"))).alias("_need"))
    sure = written(sure, "mix-needs")
    drawn = rows.where("_p > 0 and size > 0").join(sure, rows[source].eqNullSafe(sure["_ns"])).select(F.col(source).alias("_s"), "size", "_rank", "_place", "_tie", key, "_need")
    low, high, before = F.lit(0.0), F.lit(1.0), F.lit(0).cast("long")
    here = drawn.withColumns({"_low": low, "_width": high - low, "_before": before})
    for level in range(LEVELS):
        here = here.withColumn("_bin", F.least(F.floor((F.col("_place") - F.col("_low")) / F.col("_width") * SPLIT), F.lit(SPLIT - 1)))
        sums = here.groupBy("_s", "_bin").agg(F.sum("size").alias("_sum"), F.first("_before").alias("_b0"), F.first("_need").alias("_n0"), F.first("_low").alias("_l0"), F.first("_width").alias("_w0"))
        by = Window.partitionBy("_s").orderBy("_bin")
        sums = sums.withColumn("_upto", F.col("_b0") + F.sum("_sum").over(by))
        # The bin in which the running sum first passes the need; at most one row for each source.
        edge = sums.where("_upto > _n0 and _upto - _sum <= _n0").select(F.col("_s").alias("_es"), F.col("_bin").alias("_eb"), (F.col("_upto") - F.col("_sum")).alias("_eu"), (F.col("_l0") + F.col("_bin") * F.col("_w0") / SPLIT).alias("_el"), (F.col("_w0") / SPLIT).alias("_ew"))
        edge = written(edge, f"mix-edge-{level}")
        here = here.join(edge, here["_s"].eqNullSafe(edge["_es"]) & (F.col("_bin") == F.col("_eb"))).select("_s", "size", "_rank", "_place", "_tie", key, "_need", F.col("_el").alias("_low"), F.col("_ew").alias("_width"), F.col("_eu").alias("_before"))
    # Exact border within the last bin: a document stays while taking it brings the words nearer to the need.
    by = Window.partitionBy("_s").orderBy("_rank", key, "_tie")
    last = here.withColumn("_upto", F.col("_before") + F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    last = last.where("_upto - size / 2.0 <= _need")
    border = last.groupBy("_s").agg(F.max(F.struct("_rank", key, "_tie")).alias("_last"))
    floor_ = here.groupBy("_s").agg(F.min("_low").alias("_from"))
    border = written(floor_.join(border, floor_["_s"].eqNullSafe(border["_s"]), "left").select(floor_["_s"].alias("_bs"), "_from", "_last", F.lit(True).alias("_cut")), "mix-border")
    rows = ranked(sized) if texts else rows
    out = rows.join(border, rows[source].eqNullSafe(border["_bs"]), "left")
    # Sources without a border bin are taken whole: their need is not below the sum of all sizes.
    inside = F.when(F.col("_cut").isNull(), True).otherwise(
        (F.floor(F.col("_place") * SPLIT**LEVELS) < F.round(F.col("_from") * SPLIT**LEVELS)) | F.coalesce(F.struct("_rank", key, "_tie") <= F.col("_last"), F.lit(False))
    )
    copies = (F.col("_whole") + F.when((F.col("_p") > 0) & (F.col("size") > 0) & inside, 1).otherwise(0)).cast("long")
    return out.select(*unpacked(own, names), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, in the columns of docs."""
    names = apart(docs, RESULTS)[1]
    found = mix(docs, weights, most, texts=True).where("copies > 0")
    # The copies are made beside one struct, as a column of the caller's may be called as they are.
    rows = found.select(F.struct(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns)]).alias("_row"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*unpacked(docs.columns, docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (CAST('0x' || substr(md5('17:' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(floor(262144.0::DOUBLE / (size + 256))::BIGINT * size)::BIGINT AS lean, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY 3 * source_size / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, max(level) OVER () AS found FROM l),
t AS (SELECT source, source_size, lean, least(3 * source_size::DOUBLE, coalesce(found, 0) * w) AS target FROM f),
r AS (SELECT d.doc_id, d.source, size, source_size, target, lean, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, share + least(share, 3 - share) / 2 * (floor(262144.0::DOUBLE / (size + 256)) - CASE WHEN source_size > 0 THEN lean / source_size ELSE 0 END) / 1024 AS e FROM r),
q AS (SELECT *, floor(e + 1e-12)::BIGINT AS whole FROM x),
o AS (SELECT *, greatest(e - whole, 0) AS p, target - sum(whole * size) OVER (PARTITION BY source) AS need FROM q),
k AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM o),
c AS (SELECT *, sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN rank IS NOT NULL AND upto - size / 2.0 <= need THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM c
"""
