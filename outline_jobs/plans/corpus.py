"""A corpus of Markdown pages derived from the documents table by rule, once in Spark and once as DuckDB SQL.

Six lines make a page. Slots 0, 2 and 4 begin with numbered headings, odd documents have a lettered heading in slot 3, each page
has a running header and a page number; some documents, by doc_id, have a table of contents, numbering gaps, repeated
labels, bold lines, tables or a scanned last page. The plain corpus is made of the same documents without lettered headings, gaps, repeated labels,
bold lines and tables of contents: there the decisions on headings have a closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCKS = """
    SELECT doc_id, page, slot * 10 AS ord,
        CASE slot WHEN 0 THEN '# ' || page || '. ' || t WHEN 2 THEN '## ' || page || '.1 ' || t
                  WHEN 4 THEN '## ' || page || CASE WHEN doc_id % 7 = 3 THEN '.3 ' WHEN doc_id % 11 = 4 THEN '.1 ' ELSE '.2 ' END || t ELSE '(a) ' || t END AS block
    FROM lines WHERE slot IN (0, 2, 4) OR (slot = 3 AND doc_id % 2 = 1)
    UNION ALL SELECT doc_id, page, slot * 10 + 1, CASE WHEN slot = 5 AND doc_id % 13 = 2 THEN '**' || body || '**' ELSE body END FROM lines
    UNION ALL SELECT doc_id, page, -10, 'CORPUS ' || source FROM lines WHERE slot = 0
    UNION ALL SELECT doc_id, page, -9, 'Contents' FROM lines WHERE k = 0 AND doc_id % 5 = 1
    UNION ALL SELECT doc_id, page, -8, 'Part one ..... 1' FROM lines WHERE k = 0 AND doc_id % 5 = 1
    UNION ALL SELECT doc_id, page, -7, 'Part two ..... 2' FROM lines WHERE k = 0 AND doc_id % 5 = 1
    UNION ALL SELECT doc_id, page, -6, 'Part three ..... 3' FROM lines WHERE k = 0 AND doc_id % 5 = 1
    UNION ALL SELECT doc_id, page, 100, CAST(page AS VARCHAR) FROM lines WHERE slot = 0
"""
_LINES = """
    SELECT doc_id, coalesce(source, '') AS source, k, CAST(floor(k / 6) AS INT) + 1 AS page, k % 6 AS slot,
        CASE WHEN trim(substring(line, 1, 24)) = '' THEN 'Item' ELSE trim(substring(line, 1, 24)) END AS t,
        CASE WHEN doc_id % 2 = 0 THEN 'Text ' || line || ' end.' ELSE line END AS body FROM raw
"""


def _blocks(line: Column, slot: int, page: Column, plain: bool) -> list[Column]:
    """The blocks struct(ord, block) that the line in this slot of its page gives: header, four of contents, heading, text, page number; null blocks where it gives none or there is no such line."""
    odd, number = (F.col("doc_id") % 2 == 1) & F.lit(not plain), page.cast("string")
    defect = lambda n, r: (F.col("doc_id") % n == r) & F.lit(not plain)
    none = F.lit(None).cast("string")
    start = F.trim(F.substring(line, 1, 24))
    t = F.when(start == "", "Item").otherwise(start)
    body = F.when(odd, line).otherwise(F.concat(F.lit("Text "), line, F.lit(" end.")))
    third = F.when(defect(7, 3), ".3 ").when(defect(11, 4), ".1 ").otherwise(".2 ")
    heads = {0: F.concat(F.lit("# "), number, F.lit(". "), t), 2: F.concat(F.lit("## "), number, F.lit(".1 "), t), 3: F.when(odd, F.concat(F.lit("(a) "), t)), 4: F.concat(F.lit("## "), number, third, t)}
    text = F.when(defect(13, 2), F.concat(F.lit("**"), body, F.lit("**"))).otherwise(body) if slot == 5 else body
    first = slot == 0
    toc = lambda words: F.when((page == 1) & defect(5, 1), words) if first else none
    made = [(-10, F.concat(F.lit("CORPUS "), "source") if first else none), (-9, toc("Contents")), (-8, toc("Part one ..... 1")), (-7, toc("Part two ..... 2")), (-6, toc("Part three ..... 3"))]
    made += [(slot * 10, heads.get(slot, none)), (slot * 10 + 1, text), (100, number if first else none)]
    return [F.struct(F.lit(o).alias("ord"), F.when(line.isNotNull(), b).alias("block")) for o, b in made]


def corpus(spark: SparkSession, sf_dir: str, plain: bool = False) -> dict[str, DataFrame]:
    """pages (doc_id, page, markdown, plain_text, table_count, blocks, …) and ocr (doc_id, page, text).

    A document's pages are made where its row lies, without an exchange; only where ids repeat are the lines of a page gathered.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("_lines"))
    last = F.floor((F.size("_lines") - 1) / 6).cast("int").alias("_last")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").take(1)
    if repeated:
        raw = docs.select("doc_id", "source", last, F.posexplode("_lines").alias("k", "line"))
        page, slot = F.floor(F.col("k") / 6).cast("int") + 1, F.col("k") % 6
        made = [F.when(slot == s, F.filter(F.array(*_blocks(F.col("line"), s, page, plain)), lambda b: b["block"].isNotNull())) for s in range(6)]
        blocks = raw.select("doc_id", "_last", page.alias("page"), F.explode(F.coalesce(*made)).alias("b"))
        joined = F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda x: x["block"]), "\n\n")
        pages = blocks.groupBy("doc_id", "page").agg(joined.alias("markdown"), F.max("_last").alias("_last"))
    else:
        parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(F.col("_lines"), k * 6 + 1, 6))
        raw = docs.select("doc_id", "source", last, F.posexplode(parts).alias("_k", "_own")).withColumn("page", F.col("_k") + 1)
        made = [b for s in range(6) for b in _blocks(F.get("_own", F.lit(s)), s, F.col("page"), plain)]
        in_order = [b["block"] for b in made[:5]] + [b["block"] for s in range(6) for b in made[8 * s + 5 : 8 * s + 7]] + [made[7]["block"]]
        pages = raw.select("doc_id", "page", F.array_join(F.array(*in_order), "\n\n").alias("markdown"), "_last")
    pages = pages.select(
        "doc_id", "page", "markdown", F.replace(F.replace("markdown", F.lit("#")), F.lit("**")).alias("bare"), ((F.col("doc_id") % 17 == 6) & (F.col("page") == F.col("_last") + 1)).alias("scanned"),
        F.when(F.col("doc_id") % 9 == 1, 1).otherwise(0).alias("table_count"),
    )
    full = pages.select(
        "doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("document_hash"), "page", "markdown", F.when(F.col("scanned"), "").otherwise(F.col("bare")).alias("plain_text"),
        F.array().cast("array<array<double>>").alias("blocks"), "table_count", F.lit("extracted").alias("extraction_status"),
    )
    return {"pages": full, "ocr": pages.where("scanned").select("doc_id", "page", F.col("bare").alias("text"))}


def ctes(plain: bool = False) -> str:
    """CTEs pages and ocr for DuckDB, blocks0 with the blocks of each page."""
    blocks, lines = _BLOCKS, _LINES
    if plain:
        for n, r in ((7, 3), (11, 4), (13, 2), (5, 1), (2, 1)):
            blocks = blocks.replace(f"doc_id % {n} = {r}", "false")
        lines = lines.replace("doc_id % 2 = 0", "true")
    return f"""raw AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents),
lines0 AS ({lines}),
blocks0 AS ({blocks.replace("FROM lines", "FROM lines0")}),
pages0 AS (SELECT doc_id, page, string_agg(block, chr(10) || chr(10) ORDER BY ord, block) AS markdown FROM blocks0 GROUP BY doc_id, page),
pages1 AS (SELECT *, replace(replace(markdown, '#', ''), '**', '') AS bare, doc_id % 17 = 6 AND page = max(page) OVER (PARTITION BY doc_id) AS scanned, CASE WHEN doc_id % 9 = 1 THEN 1 ELSE 0 END AS table_count FROM pages0),
pages AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS document_hash, page, markdown, CASE WHEN scanned THEN '' ELSE bare END AS plain_text, table_count FROM pages1),
ocr AS (SELECT doc_id, page, bare AS text FROM pages1 WHERE scanned)"""


SQL = ctes()
