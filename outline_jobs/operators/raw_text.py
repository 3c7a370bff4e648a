"""The raw-text outline: headings and labels found line by line in plain text, without pages or noise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outline_jobs.functions import text as tx
from outline_jobs.functions.tables import once

#: Fixed values. A label ends with a closing parenthesis; what follows it may begin with one sign.
SIGN = r"[^\n\r\x{2028}\x{2029}]"
MARKED = rf"^(#{{1,6}})[{tx.WS}]+({SIGN}+)$"
LABEL = r"\(?[0-9]+(?:\.[0-9]+)*(?:\.\([a-zA-Z0-9]+\))?\)|\([a-zA-Z0-9]+\)"
NUMBERED = rf"^({LABEL})[{tx.WS}]*(?:[-:.][{tx.WS}]*|[{tx.WS}]+)({SIGN}+)$"
SEED = "seed"


def raw_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line, text, heading, label, title, level of (doc_id, text): lines without white space at their ends."""
    d = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "_raw"))
    d = once(d, "text", F.regexp_replace("_raw", rf"[{tx.WS}]+$", ""))
    marks, rest = F.regexp_extract("text", MARKED, 1), tx.strip(F.regexp_extract("text", MARKED, 2))
    d = once(d.withColumn("_marks", marks), "_rest", F.when(F.col("_marks") != "", rest).otherwise(F.col("text")))
    d = d.withColumns({"_label": F.regexp_extract("_rest", NUMBERED, 1), "_title": F.regexp_extract("_rest", NUMBERED, 2)})
    own = F.regexp_replace("_label", r"[.)]$", "")
    marked, labelled = F.col("_marks") != "", F.col("_label") != ""
    level = F.when(marked, F.length("_marks")).otherwise(1 + F.length(own) - F.length(F.replace(own, F.lit("."))) + F.when(F.contains(own, F.lit("(")), 1).otherwise(0))
    return d.select(
        "doc_id", "line", "text", (marked | labelled).alias("heading"), F.when(labelled, own).when(marked, F.length("_marks").cast("string")).alias("label"),
        F.when(labelled & marked, F.col("_title")).when(labelled, tx.strip(F.col("_title"))).when(marked, F.col("_rest")).alias("title"), F.when(marked | labelled, level).alias("level"),
    )


def raw_parents(headings: DataFrame) -> DataFrame:
    """With parent_line: the nearest heading above of a lower level, whatever the levels; levels alone go through a document's stack."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g, open_, out = g.sort_values("line"), [], []
        for line, level in zip(g["line"], g["level"]):
            while open_ and open_[-1][1] >= level:
                open_.pop()
            out.append(open_[-1][0] if open_ else None)
            open_.append((line, level))
        return pd.DataFrame({"doc_id": g["doc_id"], "line": g["line"], "parent_line": pd.array(out, "Int64")})

    found = headings.select("doc_id", F.col("line").cast("long").alias("line"), "level").groupBy("doc_id").applyInPandas(run, "doc_id long, line long, parent_line long")
    return headings.join(found, ["doc_id", "line"])


def raw_text_outline(docs: DataFrame, title: str = "") -> DataFrame:
    """Node rows of (doc_id, text): the root with what comes before the first heading, or SEED; a heading's text runs to the next one, without blank lines at its start."""
    lines = raw_lines(docs)
    heads = raw_parents(lines.where("heading")).select("doc_id", "line", "parent_line", "label", "title")
    by_line = Window.partitionBy("doc_id").orderBy("line")
    owner = F.coalesce(F.last(F.when(F.col("heading"), F.col("line")), ignorenulls=True).over(by_line), F.lit(-1)).cast("long")
    d = lines.withColumn("_owner", owner).where("not heading and (text <> '' or _owner >= 0)")
    begun = F.max(F.col("text") != "").over(Window.partitionBy("doc_id", "_owner").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_begun", begun).where("_begun")
    rows = F.sort_array(F.collect_list(F.struct("line", "text")))
    body = d.groupBy("doc_id", F.col("_owner").alias("line")).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))
    root = docs.select("doc_id", F.lit(-1).cast("long").alias("line"), F.lit(None).cast("long").alias("parent_line"), F.lit("").alias("label"), F.lit(title).alias("title"))
    every = root.unionByName(heads.withColumn("parent_line", F.coalesce("parent_line", F.lit(-1)))).join(body, ["doc_id", "line"], "left")
    top = F.col("line") < 0
    text = F.when(top, F.coalesce(F.nullif(tx.strip(F.coalesce("text", F.lit(""))), F.lit("")), F.lit(SEED))).otherwise(F.coalesce("text", F.lit("")))
    ident = lambda c: F.when(c < 0, "root").when(c >= 0, F.concat(F.lit("item-"), c.cast("string")))
    place = F.row_number().over(Window.partitionBy("doc_id", "parent_line").orderBy("line")) - 1
    return every.select("doc_id", ident(F.col("line")).alias("node_id"), ident(F.col("parent_line")).alias("parent_id"), F.col("line").alias("ord"), place.alias("sibling_pos"), "label", "title", text.alias("text"))
