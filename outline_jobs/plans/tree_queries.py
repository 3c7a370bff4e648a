"""Queries of page quality and of node tables, over the derived corpus and its line outline."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from outline_jobs.functions import text as tx
from outline_jobs.functions.tables import stage_path
from outline_jobs.operators import quality, trees
from outline_jobs.plans import corpus
from outline_jobs.plans.line_queries import sql, stages
from outline_jobs.sources import pages as src

_TOKENS = lambda c: f"regexp_extract_all(replace(lower(coalesce({c}, '')), 'ß', 'ss'), '[{tx.WORD}]+|[^{tx.WORD}{tx.WS}]')"


#: Tasks that write files of documents.
WRITERS = 64


def pages(spark, sf_dir):
    return corpus.corpus(spark, sf_dir)["pages"]


def node_table(spark, sf_dir):
    """The line outline's nodes by their line as id, which is unique in a document."""
    return keyed_by_line(stages(spark, sf_dir)["nodes"])


def keyed_by_line(n):
    place = F.row_number().over(Window.partitionBy("doc_id", "parent_key").orderBy("node_key")) - 1
    return n.select("doc_id", F.col("node_key").cast("string").alias("node_id"), F.col("parent_key").cast("string").alias("parent_id"), place.alias("sibling_pos"), "ord", "label", "title", "text", "depth", F.col("depth").alias("true_depth"))


def with_true_depth(n):
    """The line outline's nodes by their own ids, with the depth at which the level join finds them; -1 where no path from the root leads to one."""
    found = trees.recompute_depths(keyed_by_line(n)).select("doc_id", F.col("node_id").cast("int").alias("node_key"), F.col("depth").alias("true_depth"))
    return n.join(found, ["doc_id", "node_key"], "left").withColumn("true_depth", F.coalesce("true_depth", F.lit(-1)))


_DIFF = f"""x AS (SELECT doc_id, page, unnest({_TOKENS('plain_text')}) AS token, 1 AS n FROM pages UNION ALL SELECT doc_id, page, unnest({_TOKENS('markdown')}), -1 FROM pages),
diff AS (SELECT doc_id, page, token, greatest(sum(n), 0)::BIGINT AS missing, greatest(-sum(n), 0)::BIGINT AS added FROM x GROUP BY ALL HAVING sum(n) <> 0)"""
_TREE = """n AS (SELECT doc_id, node_key, parent_key, row_number() OVER (PARTITION BY doc_id, parent_key ORDER BY node_key) AS place, depth, label FROM nodes),
walk AS (SELECT doc_id, node_key, 0 AS d, CAST(node_key AS VARCHAR) AS path, '' AS number FROM n WHERE parent_key IS NULL
    UNION ALL SELECT n.doc_id, n.node_key, d + 1, path || '/' || n.node_key, CASE WHEN number = '' THEN '' || place ELSE number || '.' || place END FROM n JOIN walk w ON w.doc_id = n.doc_id AND w.node_key = n.parent_key)"""


def _reconciled(spark, sf_dir):
    p = pages(spark, sf_dir).select("doc_id", "page", "markdown", F.when(F.col("doc_id") % 3 == 0, F.concat("markdown", F.lit(" extra"))).otherwise(F.col("markdown")).alias("proposed"), (F.col("doc_id") % 2 == 0).alias("order_only"))
    return quality.reconcile_pages(p, ["doc_id", "page"]).select("doc_id", "page", "omissions", "additions", "order_changed", "adopted")


def _assessed(spark, sf_dir):
    return quality.assess_pages(pages(spark, sf_dir)).select("doc_id", "page", "status", F.array_join("reasons", ",").alias("reasons"), "coverage_missing")


def _depths(spark, sf_dir):
    return trees.recompute_depths(node_table(spark, sf_dir)).select("doc_id", "node_id", "depth", F.array_join("node_path", "/").alias("path"))


def _round_trip(spark, sf_dir):
    back = trees.flatten_trees(trees.nest_trees(node_table(spark, sf_dir)))
    return back.select("doc_id", "node_id", "parent_id", "ord", "label", "title", "text", "depth")


def _pruned(spark, sf_dir):
    n = trees.recompute_depths(node_table(spark, sf_dir))
    doomed = n.where((F.col("depth") == 1) & (F.col("sibling_pos") % 2 == 1)).select("doc_id", "node_id")
    return trees.prune_subtrees(n, doomed).select("doc_id", "node_id")


def _moved(spark, sf_dir):
    """The last first-level section goes inside the first one."""
    n = trees.recompute_depths(node_table(spark, sf_dir))
    top = n.where("depth = 1").groupBy("doc_id").agg(F.min(F.col("node_id").cast("int")).cast("string").alias("target_id"), F.max(F.col("node_id").cast("int")).cast("string").alias("node_id"))
    return trees.reparent_subtrees(n, top.withColumn("position", F.lit("inside"))).select("doc_id", "node_id", "parent_id", "depth")


def _hashed(spark, sf_dir):
    """The hash of each text as if it were a file's content."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return quality.document_hash(docs.select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))).select(F.col("path").alias("doc_id"), "document_hash")


def _selected(spark, sf_dir):
    """Selections by doc_id: in order, repeated, unsorted, out of range."""
    counts = pages(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    k = F.col("doc_id") % 4
    chosen = F.when(k == 0, F.array(F.lit(1), F.lit(2))).when(k == 1, F.array(F.lit(1), F.lit(1))).when(k == 2, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    return quality.selection_errors(counts.select("doc_id", chosen.alias("pages")), counts)


def _files(spark, sf_dir, kind):
    """Writes the corpus as a folder of JSON files for each document and reads it back."""
    p = pages(spark, sf_dir)
    objects = p.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", F.to_json(F.struct("document_hash", "page", "markdown", "table_count")).alias("j")))), lambda x: x["j"]), ","), F.lit("]")).alias("value"))
    if kind == "metadata":
        objects = p.groupBy("doc_id").agg(F.to_json(F.struct(F.concat(F.lit("sample "), F.col("doc_id").cast("string")).alias("sample_id"), F.sort_array(F.collect_list("page")).alias("selected_pages"))).alias("value"))
    if kind in ("alignment", "errors"):
        link = F.concat(F.lit('"r'), F.col("page").cast("string"), F.lit('":'), F.to_json(F.struct(F.array("page").alias("pages"), F.substring("markdown", 1, 9).alias("heading_text"), F.lit(True).alias("confirmed"))))
        objects = p.groupBy("doc_id").agg(F.when(F.col("doc_id") % 5 == 0, '["r1"]').otherwise(F.concat(F.lit("{"), F.array_join(F.collect_list(link), ","), F.lit("}"))).alias("value"))
    folder = stage_path(spark, f"files-{kind}")
    # So many tasks whatever the bytes, since a file costs more than what is in it. Tasks put their own folders in place; by default the driver alone would move all of them, one after the other.
    to = objects.select(F.col("doc_id").cast("string").alias("sample"), "value").repartition(WRITERS, "sample").write
    to.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("sample").text(folder)
    read = {"pages": src.read_pages, "metadata": src.read_metadata, "alignment": src.read_alignment, "errors": src.alignment_errors}[kind]
    return read(spark, folder).withColumn("doc_id", F.regexp_replace("doc_id", "^sample=", ""))


def _normalized(spark, sf_dir):
    """Node rows with lost ids and labels."""
    n = node_table(spark, sf_dir)
    key = F.col("node_id").cast("int")
    return trees.normalize_nodes(n.withColumns({"node_id": F.when((key % 3 != 0) & (key >= 0), F.col("node_id")), "label": F.when(key % 2 != 0, F.col("label"))})).select("doc_id", "ord", "node_id", "label", "depth")


def _written_run(spark, sf_dir):
    """Two stages written by write_run and read back."""
    folder, o = stage_path(spark, "run"), stages(spark, sf_dir)
    src.write_run({"nodes": o["nodes"], "lines": o["lines"]}, folder)
    count = lambda name: spark.read.parquet(f"{folder}/{name}").agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n"))
    return count("nodes").unionByName(count("lines"))


def _patched(spark, sf_dir):
    n = node_table(spark, sf_dir)
    key = F.col("node_id").cast("int")
    return trees.patch_nodes(n, n.where(key % 3 == 0).select("doc_id", "node_id", F.lit("patched").alias("label"), F.when(key % 2 == 0, "new").alias("title"))).select("doc_id", "node_id", "label", "title", "text")


def _moved_beside(spark, sf_dir):
    """Even documents: the last first-level section goes before the first; odd ones: the first goes after the last."""
    n = trees.recompute_depths(node_table(spark, sf_dir))
    top = n.where("depth = 1").groupBy("doc_id").agg(F.min(F.col("node_id").cast("int")).cast("string").alias("lo"), F.max(F.col("node_id").cast("int")).cast("string").alias("hi"))
    even = F.col("doc_id") % 2 == 0
    moves = top.select("doc_id", F.when(even, F.col("hi")).otherwise(F.col("lo")).alias("node_id"), F.when(even, F.col("lo")).otherwise(F.col("hi")).alias("target_id"), F.when(even, "before").otherwise("after").alias("position"))
    return trees.reparent_subtrees(n, moves).select("doc_id", "node_id", F.when(F.col("depth") == 1, F.col("sibling_pos")).alias("place"))


_ALL = {
    "tokens": (lambda s, d: pages(s, d).select("doc_id", "page", F.posexplode(tx.tokens(F.col("markdown"))).alias("pos", "token")), f"SELECT doc_id, page, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, page, {_TOKENS('markdown')} AS t FROM pages)"),
    "token_diff": (lambda s, d: quality.token_diff(pages(s, d), ["doc_id", "page"], "plain_text", "markdown"), f"SELECT * FROM (WITH {_DIFF} SELECT * FROM diff)"),
    "reconcile_pages": (_reconciled, "SELECT doc_id, page, 0 AS omissions, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS additions, doc_id % 3 = 0 AS order_changed, doc_id % 2 = 0 AND doc_id % 3 <> 0 AS adopted FROM pages"),
    "assess_pages": (_assessed, f"""SELECT doc_id, page, CASE WHEN plain = 0 THEN 'UNVERIFIABLE' WHEN reasons <> '' THEN 'NEEDS_VISUAL' ELSE 'ACCEPT' END AS status, reasons, missing AS coverage_missing FROM (SELECT *, concat_ws(',', CASE WHEN contains(markdown, chr(65533)) THEN 'UNDECODABLE_CHARACTERS' END,
        CASE WHEN plain > 0 AND missing > greatest(20, floor(plain / 5)) THEN 'BROAD_TEXT_COVERAGE_DISAGREEMENT' END, CASE WHEN table_count > 0 AND NOT contains(markdown, '|') THEN 'TABLE_STRUCTURE_RISK' END, CASE WHEN plain = 0 THEN 'CHECK_EVIDENCE_UNAVAILABLE' END) AS reasons
        FROM (WITH {_DIFF} SELECT p.*, len({_TOKENS('plain_text')}) AS plain, coalesce((SELECT sum(missing) FROM diff WHERE diff.doc_id = p.doc_id AND diff.page = p.page), 0) AS missing FROM pages p))"""),
    "canonical_revision": (lambda s, d: quality.canonical_revision(pages(s, d)), "SELECT doc_id, sha256(min(document_hash) || '|' || string_agg(page || ':' || sha256(markdown), '|' ORDER BY page)) AS revision FROM pages GROUP BY doc_id"),
    "select_pages": (lambda s, d: quality.select_pages(pages(s, d), first=2).select("doc_id", "page"), "SELECT doc_id, page FROM pages WHERE page <= 2"),
    "recompute_depths": (_depths, f"SELECT doc_id, CAST(node_key AS VARCHAR) AS node_id, d AS depth, path FROM (WITH RECURSIVE {_TREE} SELECT * FROM walk)"),
    "renumber_nodes": (lambda s, d: trees.renumber_nodes(node_table(s, d)).where("depth > 0").select("doc_id", "node_id", "label"), f"SELECT doc_id, CAST(node_key AS VARCHAR) AS node_id, number AS label FROM (WITH RECURSIVE {_TREE} SELECT * FROM walk) WHERE d > 0"),
    "nest_flatten_trees": (_round_trip, "SELECT doc_id, CAST(node_key AS VARCHAR) AS node_id, CAST(parent_key AS VARCHAR) AS parent_id, ord, label, title, text, depth FROM nodes"),
    "prune_subtrees": (_pruned, f"SELECT doc_id, CAST(node_key AS VARCHAR) AS node_id FROM (WITH RECURSIVE {_TREE} SELECT * FROM walk) WHERE d = 0 OR CAST(string_split(number, '.')[1] AS INT) % 2 = 1"),
    "reparent_subtrees": (_moved, f"""SELECT doc_id, CAST(node_key AS VARCHAR) AS node_id, CAST(CASE WHEN d = 1 AND top = hi AND lo <> hi THEN lo ELSE parent_key END AS VARCHAR) AS parent_id, d + CASE WHEN d > 0 AND top = hi AND lo <> hi THEN 1 ELSE 0 END AS depth
        FROM (SELECT w.*, n2.parent_key, CAST(string_split(path, '/')[2] AS INT) AS top, (SELECT min(node_key) FROM nodes x WHERE x.doc_id = w.doc_id AND x.depth = 1) AS lo, (SELECT max(node_key) FROM nodes x WHERE x.doc_id = w.doc_id AND x.depth = 1) AS hi FROM (WITH RECURSIVE {_TREE} SELECT * FROM walk) w JOIN nodes n2 ON n2.doc_id = w.doc_id AND n2.node_key = w.node_key)"""),
    "tree_stats": (lambda s, d: trees.tree_stats(with_true_depth(stages(s, d)["nodes"])), f"""SELECT n.doc_id, count(*) AS total_nodes, max(depth) AS max_depth, sum(CASE WHEN depth = 0 THEN 2 ELSE 1 END * len(regexp_extract_all(text, '[^{tx.WS}]+')))::BIGINT AS word_count, count(*) FILTER (depth > 0 AND trim(title) = '') AS empty_titles,
        count(*) - count(DISTINCT node_id) AS duplicate_ids, count(*) FILTER (depth <> coalesce(d, -1)) AS depth_issues FROM nodes n LEFT JOIN (WITH RECURSIVE {_TREE} SELECT doc_id, node_key, d FROM walk) w ON w.doc_id = n.doc_id AND w.node_key = n.node_key GROUP BY n.doc_id"""),
    "tree_issues": (lambda s, d: trees.tree_issues(with_true_depth(stages(s, d)["nodes"])).select("doc_id", "ord", "node_id", "issue"), "SELECT doc_id, ord, node_id, unnest(list_filter([CASE WHEN again > 1 THEN 'duplicate_id' END, CASE WHEN trim(title) = '' AND node_id <> 'root' THEN 'empty_title' END], lambda x: x IS NOT NULL)) AS issue FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, node_id ORDER BY ord) AS again FROM nodes)"),
    "document_hash": (_hashed, "SELECT doc_id, sha256(text) AS document_hash FROM documents WHERE text IS NOT NULL"),
    "select_listed_pages": (lambda s, d: quality.select_pages(p := pages(s, d), selection=p.where((F.col("doc_id") + F.col("page")) % 2 == 0)).select("doc_id", "page"), "SELECT doc_id, page FROM pages WHERE (doc_id + page) % 2 = 0"),
    "selection_errors": (_selected, "SELECT doc_id, 'pages must be unique, ascending and within the document' AS error FROM counts WHERE doc_id % 4 <> 0 OR n_pages < 2"),
    "read_pages": (lambda s, d: _files(s, d, "pages").select("doc_id", "page", "markdown", "table_count"), "SELECT CAST(doc_id AS VARCHAR) AS doc_id, page, markdown, table_count FROM pages"),
    "read_metadata": (lambda s, d: _files(s, d, "metadata").select("doc_id", "sample_id", F.size("selected_pages").alias("n_pages")), "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'sample ' || doc_id AS sample_id, n_pages FROM counts"),
    "read_alignment": (lambda s, d: _files(s, d, "alignment").select("doc_id", "reference_id", "heading_text", "confirmed"), "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'r' || page AS reference_id, substr(markdown, 1, 9) AS heading_text, true AS confirmed FROM pages WHERE doc_id % 5 <> 0"),
    "alignment_errors": (lambda s, d: _files(s, d, "errors"), "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'alignment must map reference ids to objects' AS error FROM counts WHERE doc_id % 5 = 0"),
    "normalize_nodes": (_normalized, "SELECT doc_id, ord, CASE WHEN node_key < 0 THEN 'root' WHEN node_key % 3 = 0 THEN 'item-' || substr(sha1(doc_id || ':' || ord), 1, 6) ELSE CAST(node_key AS VARCHAR) END AS node_id, CASE WHEN node_key % 2 = 0 THEN '' ELSE label END AS label, depth FROM nodes"),
    "write_run": (_written_run, "SELECT 'nodes' AS stage, count(*) AS n FROM nodes UNION ALL SELECT 'lines', count(*) FROM lines"),
    "patch_nodes": (_patched, "SELECT doc_id, CAST(node_key AS VARCHAR) AS node_id, CASE WHEN node_key % 3 = 0 THEN 'patched' ELSE label END AS label, CASE WHEN node_key % 3 = 0 AND node_key % 2 = 0 THEN 'new' ELSE title END AS title, text FROM nodes"),
    "reparent_beside": (_moved_beside, """SELECT doc_id, CAST(node_key AS VARCHAR) AS node_id, CASE WHEN depth = 1 THEN CASE WHEN doc_id % 2 = 0 THEN CASE WHEN node_key = hi AND lo <> hi THEN 0 WHEN lo <> hi THEN place + 1 ELSE place END ELSE CASE WHEN lo = hi THEN place WHEN node_key = lo THEN n - 1 ELSE place - 1 END END END AS place FROM
        (SELECT n.doc_id, n.node_key, n.depth, row_number() OVER (PARTITION BY n.doc_id, n.parent_key ORDER BY n.node_key) - 1 AS place, min(node_key) FILTER (depth = 1) OVER (PARTITION BY n.doc_id) AS lo, max(node_key) FILTER (depth = 1) OVER (PARTITION BY n.doc_id) AS hi, count(*) FILTER (depth = 1) OVER (PARTITION BY n.doc_id) AS n FROM nodes n)"""),
}

QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLES = {k: sql(v[1]) for k, v in _ALL.items()}
