"""Queries of the line outline over the derived corpus, each with the same rows in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from outline_jobs.functions import text as tx
from outline_jobs.functions.tables import once
from outline_jobs.operators import lines as op
from outline_jobs.plans import corpus
from outline_jobs.plans.line_outline import LineOutline

WS, D = tx.WS, tx.DIGIT


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '[{WS}]+', ' ', 'g')"


def bare(x: str) -> str:
    """Without Markdown marks."""
    one = f"regexp_replace({x}, '^#{{1,6}}[{WS}]+', '')"
    return strip(rf"regexp_replace(regexp_replace({one}, '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g')")


def label_case(x: str, group: int) -> str:
    """The label, rest or level by the first pattern that fits."""
    out = []
    for label, after, level in tx.LINE_LABELS:
        whole = f"(?s)^{label}{after}([^{WS}].*)$"
        found = f"regexp_extract({x}, '{whole}', 1)"
        value = {1: found, 2: strip(f"regexp_extract({x}, '{whole}', 2)"), 3: str(level) if level else f"len(string_split({found}, '.'))" if level is None else "NULL"}[group]
        out.append(f"WHEN regexp_matches({x}, '{whole}') THEN {value}")
    return f"CASE {' '.join(out)} ELSE {({1: chr(39) * 2, 2: x, 3: 'NULL'})[group]} END"


_TITLE_START = " OR ".join(f"(starts{k} AND {' AND '.join(f'noise{j} IS NOT NULL' for j in range(1, k)) or 'true'})" for k in (1, 2, 3))
_LAST = lambda k: f"max(CASE WHEN level = {k} THEN line_idx END) OVER b"

SQL = rf"""{corpus.SQL},
page_text AS (SELECT p.doc_id, p.page, length({strip('plain_text')}) < 50 AS from_ocr, coalesce(CASE WHEN length({strip('plain_text')}) < 50 THEN o.text ELSE markdown END, '') AS text FROM pages p LEFT JOIN ocr o ON o.doc_id = p.doc_id AND o.page = p.page),
l0 AS (SELECT doc_id, page, from_ocr, {strip('raw')} AS text, pos FROM (SELECT *, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM page_text)),
lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1 AS line_idx, text, page, from_ocr FROM l0 WHERE text <> ''),
n1 AS (SELECT *, CASE WHEN regexp_matches(text, '{op.PAGE_NUMBER}') THEN 'pageno' END AS noise, lower({strip(f"regexp_replace({squeeze('text')}, '{D}+', '#', 'g')")}) AS key FROM lines),
counts AS (SELECT doc_id, count(DISTINCT page) AS n_pages FROM pages GROUP BY doc_id),
rep AS (SELECT doc_id, key FROM n1 JOIN counts USING (doc_id) WHERE noise IS NULL GROUP BY doc_id, key, n_pages HAVING n_pages >= 3 AND count(DISTINCT page) >= greatest(2, floor(n_pages * 0.6::DOUBLE))),
n2 AS (SELECT n1.doc_id, line_idx, text, page, from_ocr, coalesce(noise, CASE WHEN rep.key IS NOT NULL THEN 'header' END) AS noise FROM n1 LEFT JOIN rep ON rep.doc_id = n1.doc_id AND rep.key = n1.key),
n3 AS (SELECT *, noise IS NULL AND regexp_matches(text, '{op.TOC_LINE}') AS toc FROM n2),
n4 AS (SELECT *, sum(CASE WHEN toc THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_idx) AS island FROM n3),
n5 AS (SELECT *, toc AND sum(CASE WHEN toc THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, island) >= 3 AS inrun FROM n4),
n6 AS (SELECT doc_id, line_idx, text, page, from_ocr, CASE WHEN inrun THEN 'toc' ELSE noise END AS noise, inrun AND NOT coalesce(lag(inrun) OVER (PARTITION BY doc_id ORDER BY line_idx), false) AS starts FROM n5),
n7 AS (SELECT *, {', '.join(f"coalesce(lead(starts, {k}) OVER w, false) AS starts{k}, lead(noise, {k}) OVER w AS noise{k}" for k in (1, 2, 3))} FROM n6 WINDOW w AS (PARTITION BY doc_id ORDER BY line_idx)),
noise AS (SELECT doc_id, line_idx, text, page, from_ocr, CASE WHEN noise IS NULL AND ({_TITLE_START}) AND regexp_matches({bare('text')}, '{op.TOC_TITLE}') THEN 'toc' ELSE noise END AS noise FROM n7),
c0 AS (SELECT *, {bare('text')} AS bare, regexp_matches(text, '{op.HEADING}') AS md FROM noise WHERE noise IS NULL),
c1 AS (SELECT *, {label_case('bare', 1)} AS label, {label_case('bare', 2)} AS rest, {label_case('bare', 3)} AS lev FROM c0),
candidates AS (SELECT doc_id, line_idx, CASE WHEN md AND rest = '' THEN {bare(f"regexp_extract(text, '{op.HEADING}', 2)")} WHEN md OR label <> '' THEN rest ELSE bare END AS text, label,
    CASE WHEN label <> '' THEN lev WHEN md THEN length(regexp_extract(text, '{op.HEADING}', 1)) END AS level,
    CASE WHEN md THEN 'md' WHEN label <> '' THEN 'number' ELSE 'bold' END AS source FROM c1
    WHERE md OR label <> '' OR (regexp_matches(text, '{op.BOLD_LINE}') AND length(bare) <= 80 AND NOT regexp_matches(bare, '[.。]$'))),
asked AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) - 1) / 60) AS INT) AS batch FROM candidates WHERE level IS NULL),
decisions AS (SELECT doc_id, line_idx, CASE WHEN line_idx % 3 <> 0 THEN line_idx % 4 + 1 END AS level FROM asked),
r0 AS (SELECT c.*, d.level AS model, d.doc_id IS NOT NULL AS was_asked, coalesce(c.level, d.level) AS known FROM candidates c LEFT JOIN {{DECISIONS}} d ON d.doc_id = c.doc_id AND d.line_idx = c.line_idx),
r1 AS (SELECT * FROM r0 WHERE NOT (level IS NULL AND was_asked AND model IS NULL) AND (known IS NOT NULL OR label <> '' OR source <> 'bold')),
r2 AS (SELECT *, last_value(CASE WHEN regexp_matches(label, '{tx.DECIMAL}') THEN greatest(1, least(6, known)) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM r1),
r3 AS (SELECT doc_id, line_idx, text, label, greatest(1, least(6, coalesce(known, coalesce(anchor, 0) + 1))) AS level, source, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS i FROM r2),
levels AS (SELECT doc_id, line_idx, text, label, least(i, i + min(level - i) OVER (PARTITION BY doc_id ORDER BY line_idx)) AS level, source FROM r3),
firstline AS (SELECT doc_id, min(line_idx) AS i, arg_min(text, line_idx) AS text FROM noise WHERE noise IS NULL GROUP BY doc_id),
firstcand AS (SELECT doc_id, min(line_idx) AS i, arg_min(text, line_idx) AS text, arg_min(label, line_idx) AS label FROM levels GROUP BY doc_id),
titles AS (SELECT d.doc_id, CASE WHEN c.i = l.i AND c.label = '' THEN c.text ELSE {bare('l.text')} END AS title, CASE WHEN c.i = l.i AND c.label = '' THEN l.i END AS title_line FROM (SELECT DISTINCT doc_id FROM noise) d LEFT JOIN firstline l ON l.doc_id = d.doc_id LEFT JOIN firstcand c ON c.doc_id = d.doc_id),
marked AS (SELECT n.doc_id, line_idx, text, page, from_ocr, CASE WHEN t.title_line = line_idx THEN 'title' ELSE noise END AS noise FROM noise n JOIN titles t ON t.doc_id = n.doc_id),
h0 AS (SELECT l.* FROM levels l JOIN titles t ON t.doc_id = l.doc_id WHERE t.title_line IS NULL OR t.title_line <> line_idx),
h1 AS (SELECT *, {', '.join(f"{_LAST(k)} AS at{k}" for k in range(1, 6))}, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS n FROM h0 WINDOW b AS (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h2 AS (SELECT *, greatest({', '.join(f"CASE WHEN level > {k} THEN at{k} END" for k in range(1, 6))}) AS parent_line FROM h1),
h3 AS (SELECT *, CASE WHEN label = '' THEN 'n' || n ELSE label END AS own FROM h2),
headings0 AS (SELECT doc_id, line_idx, text, label, level, source, parent_line, 1 AS depth, own AS path FROM h3 WHERE parent_line IS NULL
    UNION ALL SELECT h.doc_id, h.line_idx, h.text, h.label, h.level, h.source, h.parent_line, p.depth + 1, CASE WHEN contains(h.label, '.') THEN h.own ELSE p.path || '.' || h.own END FROM h3 h JOIN headings0 p ON p.doc_id = h.doc_id AND p.line_idx = h.parent_line),
headings AS (SELECT *, path || '-' || substr(sha1(lower({strip(squeeze('text'))})), 1, 6) AS node_id FROM headings0),
o0 AS (SELECT m.*, h.line_idx AS h, last_value(h.line_idx IGNORE NULLS) OVER (PARTITION BY m.doc_id ORDER BY m.line_idx) AS owner_line FROM marked m LEFT JOIN headings h ON h.doc_id = m.doc_id AND h.line_idx = m.line_idx WHERE m.noise IS NULL),
owned AS (SELECT doc_id, line_idx, text, page, from_ocr, noise, owner_line FROM o0 WHERE h IS NULL),
body AS (SELECT doc_id, coalesce(owner_line, -1) AS k, {strip("string_agg(text, chr(10) ORDER BY line_idx)")} AS text, min(page) AS page_start, max(page) AS page_end, max(line_idx) AS last, bool_or(from_ocr) AS from_ocr FROM owned GROUP BY ALL),
every AS (SELECT doc_id, node_id, label, text AS title, depth, line_idx, line_idx AS k, coalesce(parent_line, -1) AS p FROM headings UNION ALL SELECT doc_id, 'root', '', coalesce(title, CAST(doc_id AS VARCHAR)), 0, 0, -1, NULL FROM titles),
nodes AS (SELECT e.doc_id, e.node_id, u.node_id AS parent_id, row_number() OVER (PARTITION BY e.doc_id ORDER BY e.k) - 1 AS ord, e.label, e.title, coalesce(b.text, '') AS text, e.depth, page_start, page_end, e.line_idx AS line_start, greatest(e.line_idx, coalesce(last, 0)) AS line_end, coalesce(b.from_ocr, false) AS from_ocr, e.k AS node_key, e.p AS parent_key
    FROM every e LEFT JOIN body b ON b.doc_id = e.doc_id AND b.k = e.k LEFT JOIN every u ON u.doc_id = e.doc_id AND u.k = e.p)"""


def sql(select: str, decisions: bool = False) -> str:
    none = "(SELECT doc_id, line_idx, level FROM decisions WHERE false)"
    return "WITH RECURSIVE " + SQL.replace("{DECISIONS}", "decisions" if decisions else none) + " " + select


def stages(spark, sf_dir, decisions=None):
    c = corpus.corpus(spark, sf_dir)
    return LineOutline(c["pages"], c["ocr"], decisions)


def _stage(name, *columns):
    return lambda spark, sf_dir: stages(spark, sf_dir)[name].select(*columns)


def replies(candidates):
    """Model replies by rule: every third line is no heading, levels go round."""
    line = F.col("line_idx")
    item = F.format_string('{"line": %d, "is_heading": %s, "level": %d}', line, F.when(line % 3 != 0, "true").otherwise("false"), line % 4 + 1)
    asked = candidates.where("level is null").withColumn("_n", F.floor((F.row_number().over(op.by_line()) - 1) / 60).cast("int"))
    return asked.groupBy("doc_id", F.col("_n").alias("batch")).agg(F.concat(F.lit("Here: {\"decisions\": ["), F.array_join(F.sort_array(F.collect_list(item)), ", "), F.lit("]} done")).alias("content"))


def _modelled(name, *columns):
    def query(spark, sf_dir):
        first = stages(spark, sf_dir)
        return LineOutline(first.pages, first.ocr, op.parse_level_decisions(replies(first.candidates)), first.candidates)[name].select(*columns)

    return query


def _label_query(spark, sf_dir):
    lines = stages(spark, sf_dir)["lines"].select("doc_id", "line_idx", tx.strip_markdown(F.col("text")).alias("bare"))
    return once(lines, "l", tx.line_label(F.col("bare"))).select("doc_id", "line_idx", "bare", "l.label", "l.title", "l.level")


_FLAGS = {
    "numbering_gap": "SELECT doc_id, parent_id AS node_id, before || ' to ' || n AS detail FROM (SELECT *, lag(n) OVER (PARTITION BY doc_id, parent_key ORDER BY node_key) AS before FROM (SELECT *, CAST(string_split(label, '.')[-1] AS BIGINT) AS n FROM nodes WHERE node_key >= 0 AND regexp_matches(label, '" + tx.DECIMAL + "'))) WHERE n <> before + 1",
    "duplicate_label": "SELECT doc_id, parent_id AS node_id, label || ' occurs ' || count(*) || ' times' AS detail FROM nodes WHERE label <> '' GROUP BY doc_id, parent_key, parent_id, label HAVING count(*) > 1",
    "empty_section": "SELECT doc_id, node_id, label || ' ' || title AS detail FROM nodes n WHERE node_key >= 0 AND text = '' AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.doc_id = n.doc_id AND c.parent_key = n.node_key)",
    "ocr_derived": "SELECT doc_id, node_id, 'recognised text' AS detail FROM nodes WHERE node_key >= 0 AND from_ocr",
    "orphan_body": "SELECT doc_id, 'root' AS node_id, length(text) || ' characters before the first heading' AS detail FROM nodes WHERE node_key < 0 AND text <> ''",
}


def _flags(rule):
    return lambda spark, sf_dir: stages(spark, sf_dir)["flags"].where(F.col("rule") == rule).select("doc_id", "node_id", "detail")


def _all_flags(spark, sf_dir):
    return stages(spark, sf_dir)["flags"]


def flagship(spark, sf_dir):
    """Sections, characters of own text and numbering gaps of each document."""
    nodes = stages(spark, sf_dir)["nodes"]
    sections = nodes.groupBy("doc_id").agg(F.count(F.when(F.col("node_key") >= 0, 1)).alias("sections"), F.sum(F.length("text")).alias("own_chars"))
    gaps = op.flag_numbering_gaps(nodes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("gaps"))
    return sections.join(gaps, "doc_id", "left").select("doc_id", "sections", "own_chars", F.coalesce("gaps", F.lit(0)).cast("long").alias("numbering_gaps"))


_NODE = ("doc_id", "node_id", "parent_id", "ord", "label", "title", "text", "depth", "page_start", "page_end", "line_start", "line_end", "from_ocr")
#: name -> (query, final SELECT, whether it uses model replies)
_ALL = {
    "line_outline": (flagship, f"SELECT doc_id, count(*) FILTER (node_key >= 0) AS sections, sum(length(text))::BIGINT AS own_chars, (SELECT count(*) FROM ({_FLAGS['numbering_gap']}) g WHERE g.doc_id = nodes.doc_id) AS numbering_gaps FROM nodes GROUP BY doc_id", False),
    "derived_pages": (lambda s, d: corpus.corpus(s, d)["pages"].select("doc_id", "page", "markdown", "plain_text", "table_count"), "SELECT doc_id, page, markdown, plain_text, table_count FROM pages", False),
    "flag_scanned_pages": (lambda s, d: op.flag_scanned_pages(corpus.corpus(s, d)["pages"]).select("doc_id", "page", "scanned"), f"SELECT doc_id, page, length({strip('plain_text')}) < 50 AS scanned FROM pages", False),
    "merge_page_text": (_stage("page_text", "doc_id", "page", "text", "from_ocr"), "SELECT doc_id, page, text, from_ocr FROM page_text", False),
    "build_lines": (_stage("lines", "doc_id", "line_idx", "text", "page", "from_ocr"), "SELECT * FROM lines", False),
    "mark_page_numbers": (lambda s, d: op.mark_page_numbers(stages(s, d)["lines"]).where("noise is not null").select("doc_id", "line_idx", "text"), "SELECT doc_id, line_idx, text FROM n1 WHERE noise IS NOT NULL", False),
    "normalize_for_repeat": (lambda s, d: stages(s, d)["lines"].select("doc_id", "line_idx", tx.repeat_key(F.col("text")).alias("key")), "SELECT doc_id, line_idx, key FROM n1", False),
    "mark_repeated_headers": (lambda s, d: stages(s, d)["noise"].where("noise = 'header'").select("doc_id", "line_idx", "text"), "SELECT doc_id, line_idx, text FROM noise WHERE noise = 'header'", False),
    "looks_like_toc": (lambda s, d: stages(s, d)["lines"].where(op.looks_like_toc(F.col("text"))).select("doc_id", "line_idx"), f"SELECT doc_id, line_idx FROM lines WHERE regexp_matches(text, '{op.TOC_LINE}')", False),
    "mark_toc_runs": (lambda s, d: stages(s, d)["noise"].where("noise = 'toc'").select("doc_id", "line_idx", "text"), "SELECT doc_id, line_idx, text FROM noise WHERE noise = 'toc'", False),
    "mark_toc_title": (lambda s, d: stages(s, d)["noise"].where((F.col("noise") == "toc") & ~op.looks_like_toc(F.col("text"))).select("doc_id", "line_idx", "text"), f"SELECT doc_id, line_idx, text FROM noise WHERE noise = 'toc' AND NOT regexp_matches(text, '{op.TOC_LINE}')", False),
    "strip_markdown": (lambda s, d: stages(s, d)["lines"].select("doc_id", "line_idx", tx.strip_markdown(F.col("text")).alias("bare")), f"SELECT doc_id, line_idx, {bare('text')} AS bare FROM lines", False),
    "parse_label": (_label_query, f"SELECT *, {label_case('bare', 1)} AS label, {label_case('bare', 2)} AS title, {label_case('bare', 3)} AS level FROM (SELECT doc_id, line_idx, {bare('text')} AS bare FROM lines)", False),
    "find_line_candidates": (_stage("candidates", "doc_id", "line_idx", "text", "label", "level", "source"), "SELECT * FROM candidates", False),
    "level_request_batches": (lambda s, d: op.level_request_batches(stages(s, d)["candidates"]), "SELECT doc_id, batch, count(*) AS n_lines, string_agg(line_idx || ': ' || CASE WHEN label <> '' THEN label || ' ' ELSE '' END || text, chr(10) ORDER BY line_idx) AS items FROM asked GROUP BY doc_id, batch", False),
    "parse_level_decisions": (lambda s, d: op.parse_level_decisions(replies(stages(s, d)["candidates"])), "SELECT doc_id, line_idx, level FROM decisions", False),
    "resolve_line_levels": (lambda s, d: op.resolve_line_levels(c := stages(s, d)["candidates"], op.parse_level_decisions(replies(c))), "SELECT doc_id, line_idx, text, label, level, source FROM r3", True),
    "clamp_level_jumps": (_modelled("levels", "doc_id", "line_idx", "text", "label", "level", "source"), "SELECT * FROM levels", True),
    "pick_title": (_stage("titles", "doc_id", "title", "title_line"), "SELECT doc_id, title, title_line FROM titles", False),
    "line_parents": (_modelled("headings", "doc_id", "line_idx", "level", "parent_line"), "SELECT doc_id, line_idx, level, parent_line FROM headings", True),
    "line_node_ids": (_modelled("headings", "doc_id", "line_idx", "depth", "path", "node_id"), "SELECT doc_id, line_idx, depth, path, node_id FROM headings", True),
    "assign_lines": (_stage("owned", "doc_id", "line_idx", "owner_line"), "SELECT doc_id, line_idx, owner_line FROM owned", False),
    "assemble_line_nodes": (_stage("nodes", *_NODE), f"SELECT {', '.join(_NODE)} FROM nodes", False),
    "assemble_modelled_nodes": (_modelled("nodes", *_NODE), f"SELECT {', '.join(_NODE)} FROM nodes", True),
    "flag_document": (lambda s, d: _all_flags(s, d).where("rule in ('orphan_body', 'no_headings')").select("doc_id", "rule", "detail"), f"SELECT doc_id, 'orphan_body' AS rule, detail FROM ({_FLAGS['orphan_body']}) UNION ALL SELECT doc_id, 'no_headings', 'no heading was found' FROM nodes GROUP BY doc_id HAVING max(node_key) < 0", False),
    "line_outline_errors": (_stage("errors", "doc_id", "error"), "SELECT DISTINCT doc_id, 'no text' AS error FROM pages WHERE doc_id NOT IN (SELECT doc_id FROM lines)", False),
    "flag_numbering_gaps": (_flags("numbering_gap"), _FLAGS["numbering_gap"], False),
    "flag_duplicate_labels": (_flags("duplicate_label"), _FLAGS["duplicate_label"], False),
    "flag_empty_sections": (_flags("empty_section"), _FLAGS["empty_section"], False),
    "flag_ocr_nodes": (_flags("ocr_derived"), _FLAGS["ocr_derived"], False),
    "line_dump": (lambda s, d: op.line_dump(stages(s, d)["lines"]), "SELECT doc_id, line_idx, lpad(CAST(line_idx AS VARCHAR), greatest(5, length(CAST(line_idx AS VARCHAR)))::INT, ' ') || ' p' || page || ' ' || CASE WHEN from_ocr THEN 'OCR ' ELSE '' END || '| ' || text AS dump FROM lines", False),
    "outline_listing": (lambda s, d: op.outline_listing(stages(s, d)["nodes"]), "SELECT doc_id, ord, repeat('  ', depth) || trim(label || ' ' || title) || '  [d' || depth || ', ' || length(text) || '字, ' || coalesce('p' || page_start, '-') || ']' || CASE WHEN from_ocr THEN ' [OCR]' ELSE '' END AS listing FROM nodes", False),
}

QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLES = {k: sql(v[1], v[2]) for k, v in _ALL.items()}
