"""Texts of spans, cut from their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outline_jobs.functions.tables import once

#: Characters of the parts that a page is cut into first, so that a span is looked for in its parts and not from the page's beginning.
PART = 4096


def cut(spans: DataFrame, pages: DataFrame, name: str = "cut") -> DataFrame:
    """spans (doc_id, page, start, end and any others) with `name`, the page's text from start to end, and page_length.

    The spans of a page meet it in one row, so a page moves once, however many spans it has. The text is null where the
    span does not lie in its page, page_length is null where there is no such page; a page without text is the empty one.
    """
    others = [c for c in spans.columns if c not in ("doc_id", "page")]
    grouped = spans.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in others])).alias("_spans"))
    text = pages.select("doc_id", "page", F.coalesce("markdown", F.lit("")).alias("_page"))
    d = grouped.join(text, ["doc_id", "page"], "left").withColumn("_length", F.length("_page"))
    n_parts = F.ceil(F.coalesce("_length", F.lit(0)) / PART).cast("int")
    starts = F.when(n_parts > 0, F.sequence(F.lit(0), n_parts - 1)).otherwise(F.array().cast("array<int>"))
    d = once(d, "_parts", F.transform(starts, lambda k: F.substring(F.col("_page"), k * PART + 1, F.lit(PART)))).drop("_page")

    def piece(s):
        first = F.floor(s["start"] / PART).cast("int")
        n = F.floor((F.greatest(s["end"], s["start"] + 1) - 1) / PART).cast("int") - first + 1
        inside = (s["start"] >= 0) & (s["start"] <= s["end"]) & (s["end"] <= F.col("_length"))
        near = F.array_join(F.slice(F.col("_parts"), first + 1, n), "")
        return F.struct(s.alias("s"), F.when(inside, F.substring(near, s["start"] - first * PART + 1, s["end"] - s["start"])).alias("t"))

    d = d.select("doc_id", "page", F.col("_length").alias("page_length"), F.explode(F.transform("_spans", piece)).alias("_x"))
    return d.select("doc_id", "page", *[F.col(f"_x.s.`{c}`").alias(c) for c in others], F.col("_x.t").alias(name), "page_length")
