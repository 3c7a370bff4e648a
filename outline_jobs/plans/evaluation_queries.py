"""Queries of labels and of comparisons, over the derived corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from outline_jobs.functions import text as tx
from outline_jobs.operators import blocks, evaluation
from outline_jobs.functions.tables import once
from outline_jobs.plans.evidence_queries import LABEL, READINGS
from outline_jobs.plans.line_queries import sql, stages, strip
from outline_jobs.plans.tree_queries import _TOKENS, pages


def labelled(lines):
    """Every line with its label, read from the visible text as the reference does; '' and the whole text without one."""
    d = once(lines, "clean", blocks.clean_block(F.col("text"))["clean"])
    title = F.when(F.col("clean").rlike(tx.BLOCK_LABEL), F.regexp_extract("clean", tx.BLOCK_LABEL, 2)).otherwise(F.col("clean"))
    return d.select("doc_id", "line_idx", F.regexp_extract("clean", tx.BLOCK_LABEL, 1).alias("label"), title.alias("title"))


def readings(labels):
    """Every reading of every label."""
    d = once(labels, "r", tx.label_readings(F.col("label")))
    return d.select("doc_id", "line_idx", F.explode("r").alias("r")).select("doc_id", "line_idx", "r.family", "r.value", "r.series")


def _matched(spark, sf_dir):
    return labelled(stages(spark, sf_dir)["lines"])


_BARE = f"CASE WHEN text LIKE '#%' THEN regexp_replace(regexp_replace(text, '^#{{1,6}}[{tx.WS}]+', ''), '(?is)(?:[{tx.WS}]*<sup\\b[^>]*>.*?</sup>)+[{tx.WS}]*$', '') ELSE text END"
_LABELS = f"""clean AS (SELECT doc_id, line_idx, {strip("CASE WHEN b LIKE '**%' AND b LIKE '%**' THEN substr(b, 3, greatest(length(b) - 4, 0)::INT) ELSE b END")} AS clean FROM (SELECT doc_id, line_idx, {_BARE} AS b FROM lines)),
l AS (SELECT doc_id, line_idx, regexp_extract(clean, '{LABEL}', 1) AS label, CASE WHEN regexp_matches(clean, '{LABEL}') THEN regexp_extract(clean, '{LABEL}', 2) ELSE clean END AS title FROM clean),
bare AS (SELECT *, regexp_replace(label, '^[().]+|[().]+$', '', 'g') AS bare, CASE WHEN label LIKE '(%' THEN 'parenthesized' WHEN label[-1] IN ('.', ')') THEN label[-1] ELSE 'bare' END AS ending FROM l)"""
_WORTH = " ".join(f"WHEN '{k}' THEN {v}" for k, v in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items())


def _roman(spark, sf_dir):
    words = stages(spark, sf_dir)["lines"].select("doc_id", "line_idx", F.posexplode(F.split("text", " ")).alias("pos", "label"))
    d = once(words, "bare", tx.bare_label(F.col("label")))
    return d.where(F.upper("bare").rlike(tx.ROMAN)).select("doc_id", "line_idx", "pos", "bare", tx.roman_value(F.col("bare")).alias("value"))


def _altered(nodes):
    """Another run: every seventh node with another text, every eleventh with another title."""
    return nodes.withColumns({"text": F.when(F.col("node_key") % 7 == 3, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text")), "title": F.when(F.col("node_key") % 11 == 5, F.concat("title", F.lit(" x"))).otherwise(F.col("title"))})


def _runs(spark, sf_dir):
    n = stages(spark, sf_dir)["nodes"].select("doc_id", F.col("node_key").cast("string").alias("node_id"), F.col("parent_key").cast("string").alias("parent_id"), F.col("line_start").alias("page"), "label", "title", "depth", "text", "node_key")
    out = evaluation.compare_runs(n, _altered(n))
    # The identity of a node is its line, label and title; the line tells it and its title which side it is from.
    line = F.when(F.col("identity") == "root", -1).otherwise(F.get_json_object("identity", "$.page").cast("int"))
    side = F.when(F.col("status") == "changed", "both").when(F.get_json_object("identity", "$.title").endswith(" x"), "right").otherwise("left")
    return out.select("doc_id", line.alias("node_key"), "status", F.array_join("fields", ",").alias("fields"), side.alias("side"))


def _line_diff(spark, sf_dir):
    n = stages(spark, sf_dir)["nodes"].select("doc_id", "node_key", "title", F.col("text").alias("own"))
    return evaluation.body_line_diff(n.join(_altered(n.withColumnRenamed("own", "text")).select("doc_id", "node_key", F.col("text").alias("other")), ["doc_id", "node_key"]), ["doc_id", "node_key"], "own", "other")


def _consistency(spark, sf_dir):
    source = pages(spark, sf_dir).select("doc_id", F.col("plain_text").alias("text"))
    return evaluation.text_consistency(stages(spark, sf_dir)["nodes"], source)


_ALL = {
    "match_label": (_matched, f"SELECT doc_id, line_idx, label, title FROM (WITH {_LABELS} SELECT * FROM l)"),
    "label_grammar": (lambda s, d: _matched(s, d).select("doc_id", "line_idx", tx.label_grammar(F.col("label")).alias("grammar")), f"SELECT doc_id, line_idx, CASE WHEN regexp_matches(label, '[A-Za-z]') THEN 'ambiguous' ELSE 'numeric_or_raw' END AS grammar FROM (WITH {_LABELS} SELECT * FROM l)"),
    "numeric_depth": (lambda s, d: _matched(s, d).select("doc_id", "line_idx", tx.numeric_depth(F.col("label")).alias("depth")).where("depth is not null"), f"SELECT doc_id, line_idx, len(string_split(bare, '.')) AS depth FROM (WITH {_LABELS} SELECT * FROM bare) WHERE regexp_matches(bare, '{tx.DECIMAL}')"),
    "roman_value": (_roman, f"""SELECT doc_id, line_idx, pos, bare, sum(CASE WHEN v < nxt THEN -v ELSE v END)::INT AS value FROM (SELECT *, coalesce(lead(v) OVER (PARTITION BY doc_id, line_idx, pos ORDER BY i), 0) AS nxt FROM (SELECT *, CASE substr(upper(bare), i::INT, 1) {_WORTH} ELSE 0 END AS v FROM
        (SELECT *, unnest(range(1, length(bare) + 1)) AS i FROM (SELECT *, regexp_replace(label, '^[().]+|[().]+$', '', 'g') AS bare FROM (SELECT doc_id, line_idx, unnest(string_split(text, ' ')) AS label, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM lines)) WHERE bare <> '' AND regexp_matches(upper(bare), '^M{{0,3}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})$')))) GROUP BY doc_id, line_idx, pos, bare"""),
    "label_interpretations": (lambda s, d: readings(_matched(s, d)).withColumn("value", F.col("value").cast("string")), f"SELECT doc_id, line_idx, family, CAST(value AS VARCHAR) AS value, series FROM (WITH {_LABELS}, {READINGS} SELECT * FROM readings)"),
    "compare_runs": (_runs, """SELECT n.doc_id, n.node_key, 'unmatched' AS status, '' AS fields, side FROM nodes n, (VALUES ('left'), ('right')) v(side) WHERE node_key >= 0 AND node_key % 11 = 5
        UNION ALL SELECT n.doc_id, n.node_key, 'changed', concat_ws(',', CASE WHEN p.node_key % 11 = 5 THEN 'parent' END, CASE WHEN n.node_key % 7 = 3 THEN 'own_text' END), 'both' FROM nodes n LEFT JOIN nodes p ON p.doc_id = n.doc_id AND p.node_key = n.parent_key WHERE NOT (n.node_key >= 0 AND n.node_key % 11 = 5) AND (coalesce(p.node_key % 11 = 5, false) OR n.node_key % 7 = 3)"""),
    "body_line_diff": (_line_diff, "SELECT doc_id, node_key, 'more' AS line, 0 AS missing, 1 AS added FROM nodes WHERE node_key % 7 = 3"),
    "text_consistency": (_consistency, f"SELECT doc_id, token, greatest(sum(n), 0)::BIGINT AS missing, greatest(-sum(n), 0)::BIGINT AS added FROM (SELECT doc_id, unnest({_TOKENS('plain_text')}) AS token, 1 AS n FROM pages UNION ALL SELECT doc_id, unnest({_TOKENS(chr(40) + 'label || chr(32) || title || chr(32) || text)')}), -1 FROM nodes) GROUP BY doc_id, token HAVING sum(n) <> 0"),
}

QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLES = {k: sql(v[1]) for k, v in _ALL.items()}
