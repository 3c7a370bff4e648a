"""Queries of the evidence outline with DuckDB oracles.

Blocks and evidence run over the derived corpus. Decisions, body, checks and evaluation run over its plain form, all documents of it, where they have a closed form:
every `# p. T` is a section of the root, every `## p.k T` one of `# p.`, page numbers are body, and the header line of documents with fewer than three pages stays open.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from outline_jobs.functions import text as tx
from outline_jobs.operators import blocks, body, checks, decisions, evaluation, quality, raw_text, trees
from outline_jobs.plans import corpus
from outline_jobs.plans.evidence_outline import EvidenceOutline
from outline_jobs.plans.line_queries import squeeze, strip

WS, D = tx.WS, tx.DIGIT


@lru_cache(maxsize=4)
def _kept(app: str, sf_dir: str, plain: bool, spark) -> EvidenceOutline:
    return EvidenceOutline(corpus.corpus(spark, sf_dir, plain)["pages"])


def outline(spark, sf_dir, plain=True) -> EvidenceOutline:
    """One run for all queries of a session, so that its stage tables are made once."""
    return _kept(spark.sparkContext.applicationId, sf_dir, plain, spark)


def _flat(c: str):
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",").alias(c)


# ---- Blocks and evidence, over the derived corpus.
_WORTH = " ".join(f"WHEN '{k}' THEN {v}" for k, v in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items())
_SIGN = lambda x: f"(CASE {x} {_WORTH} ELSE 0 END)"
_ROMAN = "^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
_ROMAN_SUM = f"list_sum(list_transform(range(1, length(bare) + 1), lambda i: CASE WHEN {_SIGN('substr(upper(bare), i, 1)')} < {_SIGN('substr(upper(bare), i + 1, 1)')} THEN -1 ELSE 1 END * {_SIGN('substr(upper(bare), i, 1)')}))"
_COUNT = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
#: Patterns as the block outline fixes them, spelled out here apart from the operator.
LABEL = rf"(?s)^({D}+(?:\.{D}+)*[.)]?|\([A-Za-z0-9]+\)|[A-Za-z]+[.)])[{WS}]+(.+)$"
_LIST = lambda *flags: f"list_filter([{', '.join(flags)}], lambda x: x IS NOT NULL)"
_IF = lambda cond, name: f"CASE WHEN {cond} THEN '{name}' END"
_HAS = lambda name: f"list_contains(signals, '{name}')"

_CASED = "CASE WHEN bare = upper(bare) AND lower(bare) <> bare THEN 'upper' ELSE 'lower' END"


def readings_of(name: str, source: str, key: str) -> str:
    """A CTE of all readings of labels (bare, ending) in a source."""
    return rf"""{name} AS (SELECT doc_id, {key}, 1 AS k, 'numeric' AS family, TRY_CAST(string_split(bare, '.')[-1] AS DECIMAL(38, 0)) AS value, 'numeric:' || ending || ':[' || array_to_string(list_transform(string_split(bare, '.')[:-2], lambda x: regexp_replace(x, '^0+(.)', '\1')), ', ') || ']' AS series FROM {source} WHERE regexp_matches(bare, '^{D}+(\.{D}+)*$')
    UNION ALL SELECT doc_id, {key}, 1, 'alpha', ascii(lower(bare)) - 96, 'alpha:' || {_CASED} || ':' || ending FROM {source} WHERE regexp_matches(bare, '^[A-Za-z]$')
    UNION ALL SELECT doc_id, {key}, 2, 'roman', {_ROMAN_SUM}, 'roman:' || {_CASED} || ':' || ending FROM {source} WHERE bare <> '' AND regexp_matches(upper(bare), '{_ROMAN}'))"""


READINGS = readings_of("readings", "bare", "line_idx")

BLOCKS = rf"""{{CORPUS}},
rev AS (SELECT doc_id, sha256(min(document_hash) || '|' || string_agg(page || ':' || sha256(markdown), '|' ORDER BY page)) AS revision FROM pages GROUP BY doc_id),
s0 AS (SELECT doc_id, page, block, ord, coalesce(sum(length(block) + 2) OVER (PARTITION BY doc_id, page ORDER BY ord, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM blocks0),
s1 AS (SELECT doc_id, page, place + length(block) - length(regexp_replace(block, '^[{WS}]+', '')) AS start, {strip('block')} AS raw FROM s0),
spans AS (SELECT doc_id, page, CAST(row_number() OVER p - 1 AS INT) AS pos, count(*) OVER (PARTITION BY doc_id, page) AS n, CAST(start AS INT) AS start, CAST(start + length(raw) AS INT) AS "end", raw,
    {_COUNT(squeeze('raw'), '[^ ]+')} >= 12 AND NOT regexp_matches(raw, '^(#|>|- |\* |\*\*)') AND NOT regexp_matches(raw, '{LABEL}') AS prose FROM s1 WHERE raw <> '' WINDOW p AS (PARTITION BY doc_id, page ORDER BY start)),
margins AS (SELECT doc_id, edge, raw FROM (SELECT doc_id, page, raw, 'first' AS edge FROM spans WHERE pos = 0 UNION ALL SELECT doc_id, page, raw, 'last' FROM spans WHERE pos = n - 1) WHERE length(raw) <= 180 GROUP BY ALL HAVING count(DISTINCT page) >= 3),
b0 AS (SELECT *, coalesce(lead(prose) OVER (PARTITION BY doc_id ORDER BY page, pos), false) AS following, CASE WHEN raw LIKE '#%' THEN length(regexp_extract(raw, '^#+')) END AS markdown_level, regexp_replace(raw, '^#{{1,6}}[{WS}]+', '') AS b FROM spans),
b1 AS (SELECT * REPLACE (CASE WHEN markdown_level IS NULL THEN b ELSE regexp_replace(b, '(?is)(?:[{WS}]*<sup\b[^>]*>.*?</sup>)+[{WS}]*$', '') END AS b) FROM b0),
b2 AS (SELECT *, b LIKE '**%' AND b LIKE '%**' AS bold, {strip("CASE WHEN b LIKE '**%' AND b LIKE '%**' THEN substr(b, 3, greatest(length(b) - 4, 0)::INT) ELSE b END")} AS clean FROM b1),
b3 AS (SELECT *, regexp_extract(clean, '{LABEL}', 1) AS label, CASE WHEN regexp_matches(clean, '{LABEL}') THEN regexp_extract(clean, '{LABEL}', 2) ELSE clean END AS title, CASE WHEN pos = 0 THEN 'first' WHEN pos = n - 1 THEN 'last' END AS edge FROM b2),
b4 AS (SELECT b3.*, m.raw IS NOT NULL AS margin FROM b3 LEFT JOIN margins m ON m.doc_id = b3.doc_id AND m.edge = b3.edge AND m.raw = b3.raw),
b5 AS (SELECT *, {_LIST(_IF('markdown_level IS NOT NULL', 'markdown_heading'), _IF("label <> '' AND length(clean) < 180", 'numbered_title_like'), _IF('bold AND length(clean) < 180', 'standalone_bold'), _IF('upper(clean) = clean AND lower(clean) <> clean AND length(clean) < 100', 'uppercase'), _IF(f"length(clean) < 100 AND {_COUNT('clean', blocks.LINE_ENDS)} <= 1 AND NOT regexp_matches(clean, '[.:;]$')", 'isolated_short_block'))} AS first,
    {_LIST(_IF(f"regexp_matches(raw, '^(>|[-*+] |```|~~~)') OR regexp_matches(raw, '(?m){blocks.TABLE_RULE}')", 'body_markup'), _IF(f"markdown_level IS NULL AND NOT bold AND {_COUNT('raw', '(?m)' + blocks.LIST_ITEM)} >= 2", 'body_markup'), _IF(f"markdown_level IS NULL AND label = '' AND regexp_matches(clean, '^{D}+$')", 'bare_number'), _IF("markdown_level IS NULL AND label = '' AND NOT bold AND margin", 'repeated_page_margin'), _IF('following', 'following_prose'))} AS more FROM b4),
candidates AS (SELECT b.doc_id, CAST(row_number() OVER (PARTITION BY b.doc_id ORDER BY page, start) - 1 AS INT) AS ord, 'c-' || substr(sha256(revision || ':' || page || ':' || start || ':' || "end"), 1, 16) AS candidate_id, page, start, "end", raw, clean, bold, label, title, markdown_level, list_concat(first, more) AS signals,
    CASE WHEN regexp_matches(label, '[A-Za-z]') THEN 'ambiguous' ELSE 'numeric_or_raw' END AS label_grammar FROM b5 b JOIN rev ON rev.doc_id = b.doc_id WHERE len(first) > 0),
l0 AS (SELECT *, regexp_replace(label, '^[().]+|[().]+$', '', 'g') AS bare, CASE WHEN label LIKE '(%' THEN 'parenthesized' WHEN label[-1] IN ('.', ')') THEN label[-1] ELSE 'bare' END AS ending FROM candidates),
l1 AS (SELECT *, regexp_matches(bare, '^{D}+(\.{D}+)*$') AS num FROM l0),
{readings_of('r0', 'l1', 'ord')},
m0 AS (SELECT r.*, c.candidate_id, c.markdown_level FROM r0 r JOIN candidates c ON c.doc_id = r.doc_id AND c.ord = r.ord WHERE NOT {_HAS('body_markup')} AND (markdown_level IS NOT NULL OR {_HAS('standalone_bold')} OR {_HAS('isolated_short_block')}) AND (family <> 'numeric' OR markdown_level IS NOT NULL OR ({_HAS('standalone_bold')} AND {_HAS('following_prose')}))),
m1 AS (SELECT *, CASE WHEN lag(value) OVER s + 1 = value AND lag(markdown_level) OVER s IS NOT DISTINCT FROM markdown_level THEN lag(candidate_id) OVER s END AS before, CASE WHEN lead(value) OVER s = value + 1 AND lead(markdown_level) OVER s IS NOT DISTINCT FROM markdown_level THEN lead(candidate_id) OVER s END AS after FROM m0 WINDOW s AS (PARTITION BY doc_id, series ORDER BY ord)),
peers AS (SELECT doc_id, ord, series, concat_ws(',', before, after) AS peers FROM m1 WHERE before IS NOT NULL OR after IS NOT NULL),
styles AS (SELECT doc_id, ord FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, markdown_level) AS same FROM candidates WHERE markdown_level IS NOT NULL AND label = '' AND {_HAS('following_prose')}) WHERE same >= 2),
e0 AS (SELECT l.*, CASE WHEN num THEN len(string_split(bare, '.')) END AS numeric_level, (SELECT count(*) FROM r0 r JOIN peers p ON p.doc_id = r.doc_id AND p.ord = r.ord AND p.series = r.series WHERE r.doc_id = l.doc_id AND r.ord = l.ord) AS found,
    (SELECT min({{'k': r.k, 'family': r.family, 'value': r.value, 'series': r.series}}) FROM r0 r JOIN peers p ON p.doc_id = r.doc_id AND p.ord = r.ord AND p.series = r.series WHERE r.doc_id = l.doc_id AND r.ord = l.ord) AS one,
    (SELECT min({{'k': r.k, 'family': r.family, 'value': r.value, 'series': r.series}}) FROM r0 r WHERE r.doc_id = l.doc_id AND r.ord = l.ord) AS first_reading, (SELECT count(*) FROM r0 r WHERE r.doc_id = l.doc_id AND r.ord = l.ord) AS n_readings,
    EXISTS (SELECT 1 FROM styles s WHERE s.doc_id = l.doc_id AND s.ord = l.ord) AS styled FROM l1 l),
e1 AS (SELECT *, {_LIST(_IF('found > 1', 'LABEL_INTERPRETATION_CONFLICT'), _IF('numeric_level <> markdown_level', 'EVIDENCE_CONFLICT'))} AS conflicts FROM e0),
e2 AS (SELECT *, CASE WHEN numeric_level IS NOT NULL AND markdown_level IS NOT NULL AND len(conflicts) = 0 THEN 1 WHEN found = 1 AND len(conflicts) = 0 THEN 2 WHEN styled THEN 3 END AS rule, {_HAS('body_markup')} OR {_HAS('bare_number')} AS isbody, {_HAS('repeated_page_margin')} AS ismargin FROM e1),
e3 AS (SELECT *, CASE WHEN rule = 1 THEN first_reading WHEN found = 1 THEN one END AS pick FROM e2),
e4 AS (SELECT *, coalesce(pick.family = 'numeric', false) AND markdown_level IS NULL AND NOT ({_HAS('standalone_bold')} AND {_HAS('following_prose')}) AS listed FROM e3),
e5 AS (SELECT * REPLACE (CASE WHEN NOT isbody AND NOT ismargin AND NOT listed THEN pick END AS pick), CASE WHEN isbody THEN 'EXPLICIT_BODY_SYNTAX' WHEN ismargin THEN 'REPEATED_PAGE_MARGIN' WHEN NOT listed THEN CASE rule WHEN 1 THEN 'CONSISTENT_MARKDOWN_NUMBERING' WHEN 2 THEN 'CONSISTENT_LABEL_SEQUENCE' WHEN 3 THEN 'REPEATED_HEADING_STYLE_WITH_PROSE' END END AS support FROM e4),
e6 AS (SELECT *, last_value(CASE WHEN pick.family = 'roman' AND support IS NOT NULL AND len(conflicts) = 0 THEN candidate_id WHEN pick.family = 'numeric' AND support IS NOT NULL THEN '' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS roman FROM e5),
e7 AS (SELECT *, coalesce(support IS NULL AND len(conflicts) = 0 AND roman <> '' AND markdown_level IS NOT NULL AND {_HAS('following_prose')} AND NOT {_HAS('body_markup')} AND n_readings = 1 AND first_reading.family = 'alpha' AND first_reading.value = 1, false) AS firstalpha FROM e6),
evidence AS (SELECT doc_id, ord, candidate_id, numeric_level, markdown_level, CASE WHEN firstalpha THEN 'FIRST_ALPHA_HEADING_IN_ROMAN_CONTEXT' ELSE coalesce(support, '') END AS support, array_to_string(conflicts, ',') AS conflicts, CASE WHEN firstalpha THEN first_reading.series ELSE pick.series END AS series,
    coalesce((SELECT peers FROM peers p WHERE p.doc_id = e7.doc_id AND p.ord = e7.ord AND p.series = e7.pick.series), '') AS peers, CASE WHEN firstalpha THEN roman END AS context_anchor FROM e7)"""


def sql(select: str, plain: bool = False, more: str = "") -> str:
    return "WITH RECURSIVE " + BLOCKS.replace("{CORPUS}", corpus.ctes(plain)) + more + " " + select


def _evidence(spark, sf_dir):
    return outline(spark, sf_dir, False).evidence.select(
        "doc_id", "ord", "candidate_id", "numeric_level", "markdown_level", F.array_join("support", ",").alias("support"), _flat("conflicts"), F.col("selected.series").alias("series"), F.array_join("sequence_peers", ",").alias("peers"), "context_anchor")


def _spans(spark, sf_dir):
    return blocks.block_spans(corpus.corpus(spark, sf_dir)["pages"])


_BLOCK_QUERIES = {
    "block_spans": (lambda s, d: _spans(s, d).where("raw is not null").select("doc_id", "page", "pos", "start", "end", "raw"), 'SELECT doc_id, page, pos, start, "end", raw FROM spans'),
    "page_margins": (lambda s, d: blocks.page_margins(_spans(s, d)), "SELECT * FROM margins"),
    "clean_block": (lambda s, d: _spans(s, d).where("raw is not null").select("doc_id", "page", "pos", blocks.clean_block(F.col("raw")).alias("c")).select("doc_id", "page", "pos", "c.clean", "c.bold"), "SELECT doc_id, page, pos, clean, bold FROM b3"),
    "block_signals": (lambda s, d: blocks.block_signals(_spans(s, d)).select("doc_id", "page", "start", "label", "title", "markdown_level", _flat("signals")), "SELECT doc_id, page, start, label, title, markdown_level, array_to_string(signals, ',') AS signals FROM candidates"),
    "following_prose": (lambda s, d: blocks.block_signals(_spans(s, d)).where(F.array_contains("signals", "following_prose")).select("doc_id", "page", "start"), f"SELECT doc_id, page, start FROM candidates WHERE {_HAS('following_prose')}"),
    "block_candidate_ids": (lambda s, d: outline(s, d, False).candidates.select("doc_id", "ord", "candidate_id", "page", "start", "end", "label_grammar"), 'SELECT doc_id, ord, candidate_id, page, start, "end", label_grammar FROM candidates'),
    "sequence_peers": (lambda s, d: blocks.sequence_peers(outline(s, d, False).candidates).select("doc_id", "ord", "series", _flat("peers")), "SELECT * FROM peers"),
    "heading_styles": (lambda s, d: blocks.heading_styles(outline(s, d, False).candidates), "SELECT * FROM styles"),
    "build_evidence": (_evidence, "SELECT * FROM evidence"),
    "roman_context": (lambda s, d: _evidence(s, d).select("doc_id", "ord", "support", "context_anchor"), "SELECT doc_id, ord, support, context_anchor FROM evidence"),
}

# ---- Decisions, body and checks over the plain corpus, in closed form.
#: c: candidates with kind (section, open header, body) and the heading each belongs to; own: text of each section from blocks and the blank lines between them.
PLAIN = f""",
n_pages AS (SELECT doc_id, max(page) AS last FROM pages GROUP BY doc_id),
c AS (SELECT k.*, last, CASE WHEN label <> '' AND markdown_level = 1 THEN 'top' WHEN label <> '' AND markdown_level = 2 THEN 'sub' WHEN {_HAS('bare_number')} OR {_HAS('repeated_page_margin')} THEN 'body' ELSE 'open' END AS kind FROM candidates k JOIN n_pages p ON p.doc_id = k.doc_id),
tops AS (SELECT doc_id, page, candidate_id AS top FROM c WHERE kind = 'top'),
d AS (SELECT c.*, CASE kind WHEN 'top' THEN 'root' WHEN 'sub' THEN top END AS parent_id, CASE kind WHEN 'open' THEN 'unknown' WHEN 'body' THEN 'body' ELSE 'section' END AS role, CASE kind WHEN 'open' THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status,
    CASE kind WHEN 'open' THEN 'ROLE_UNCERTAIN' WHEN 'body' THEN CASE WHEN {_HAS('bare_number')} THEN 'EXPLICIT_BODY_SYNTAX' ELSE 'REPEATED_PAGE_MARGIN' END WHEN 'sub' THEN 'ACTIVE_NUMERIC_PREFIX' ELSE CASE WHEN c.page = 1 THEN 'CONSISTENT_MARKDOWN_NUMBERING' ELSE 'ACTIVE_NUMERIC_SERIES' END END AS reasons FROM c LEFT JOIN tops t ON t.doc_id = c.doc_id AND t.page = c.page),
sections AS (SELECT doc_id, candidate_id AS node_id, parent_id, CASE kind WHEN 'top' THEN 1 ELSE 2 END AS depth, label, title, ord, page, start, "end" FROM d WHERE role = 'section'),
o0 AS (SELECT s.doc_id, s.page, s.place, s.block, x.node_id AS heading, row_number() OVER (PARTITION BY s.doc_id, s.page ORDER BY s.place DESC) = 1 AS lastblock, p.last FROM s0 s JOIN n_pages p ON p.doc_id = s.doc_id LEFT JOIN sections x ON x.doc_id = s.doc_id AND x.page = s.page AND x.start = s.place),
o1 AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, place), 'root') AS owner FROM o0),
own AS (SELECT doc_id, owner AS node_id, string_agg(CASE WHEN heading IS NULL THEN block ELSE '' END || CASE WHEN NOT lastblock THEN chr(10) || chr(10) WHEN page < last THEN chr(10) ELSE '' END, '' ORDER BY page, place) AS own_text, sum(CASE WHEN lastblock AND page < last THEN 1 ELSE 0 END) AS separators FROM o1 GROUP BY ALL),
roots AS (SELECT doc_id, 'root' AS node_id FROM n_pages),
nodes AS (SELECT s.doc_id, s.node_id, s.parent_id, s.depth, s.label, s.title, coalesce(own_text, '') AS text, coalesce(separators, 0) AS separators, s.ord, s.page FROM sections s LEFT JOIN own o ON o.doc_id = s.doc_id AND o.node_id = s.node_id
    UNION ALL SELECT r.doc_id, 'root', NULL, 0, '', '', coalesce(own_text, ''), coalesce(separators, 0), -1, NULL FROM roots r LEFT JOIN own o ON o.doc_id = r.doc_id AND o.node_id = 'root'),
marks AS (SELECT doc_id, page, start, "end", kind FROM c WHERE kind <> 'body'),
segs AS (SELECT p.doc_id, p.page, unnest(list_sort(list_distinct(list_concat([0, length(markdown)], coalesce((SELECT list(start) FROM marks m WHERE m.doc_id = p.doc_id AND m.page = p.page), []), coalesce((SELECT list("end") FROM marks m WHERE m.doc_id = p.doc_id AND m.page = p.page AND kind <> 'open'), []))))) AS start, markdown FROM pages p),
g0 AS (SELECT doc_id, page, start, lead(start) OVER (PARTITION BY doc_id, page ORDER BY start) AS "end", markdown FROM segs),
g1 AS (SELECT g.*, s.node_id AS heading, o.candidate_id AS openid FROM g0 g LEFT JOIN sections s ON s.doc_id = g.doc_id AND s.page = g.page AND s.start = g.start LEFT JOIN (SELECT * FROM c WHERE kind = 'open') o ON o.doc_id = g.doc_id AND o.page = g.page AND o.start = g.start WHERE g."end" IS NOT NULL),
g2 AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER w, 'root') AS owner, count(heading) OVER w AS island FROM g1 WINDOW w AS (PARTITION BY doc_id ORDER BY page, start)),
segments AS (SELECT *, CASE WHEN heading IS NULL THEN 'ASSIGNED' ELSE 'HEADING' END AS status, count(openid) OVER (PARTITION BY doc_id, island ORDER BY page, start) > 0 AS provisional FROM g2),
found AS (SELECT doc_id, page, CAST(page AS INT) AS region, candidate_id, start, "end" FROM c WHERE kind = 'open')"""


def _plain(select: str) -> str:
    return sql(select, True, PLAIN)


def _decisions(spark, sf_dir):
    return outline(spark, sf_dir).decided.select("doc_id", F.col("ord").cast("int").alias("ord"), "candidate_id", "role", "parent_id", "status", _flat("reasons"))


def _regions(spark, sf_dir):
    o = outline(spark, sf_dir)
    return o.regions.select("doc_id", "region", F.array_join("candidate_ids", ",").alias("candidate_ids"), F.array_join("anchors", ",").alias("anchors"), F.size("outline").alias("n_outline"), "reason")


def _answers(spark, sf_dir):
    """Replies by rule: bound ones say body, every third names no candidate of the region, every fifth is for another request."""
    r = outline(spark, sf_dir).regions
    doc = F.col("doc_id")
    one = F.struct(F.when(doc % 3 == 1, "c-0").otherwise(F.element_at("candidate_ids", 1)).alias("candidate_id"), F.lit("body").alias("role"), F.lit(None).cast("string").alias("parent_id"))
    return r.where(doc % 4 != 3).select("doc_id", "region_id", F.lit("structure").alias("kind"), F.when(doc % 5 == 2, "other").otherwise(F.col("fingerprint")).alias("fingerprint"), F.array(one).alias("response"))


_REPLY = "CASE WHEN doc_id % 4 = 3 THEN 'unavailable' WHEN doc_id % 5 = 2 OR doc_id % 3 = 1 THEN 'rejected' ELSE 'returned' END"


def _replied(spark, sf_dir):
    o = outline(spark, sf_dir)
    return decisions.apply_responses(o.decided, o.regions, _answers(spark, sf_dir))


def _proposed(spark, sf_dir):
    """Routing over the plain corpus: every third page has a proposal that turns its blocks round, every fifth is bound to another page, every seventh page is replaced by hand."""
    p = outline(spark, sf_dir).given
    marks = quality.page_request(p, quality.canonical_revision(p))
    turned = F.array_join(F.reverse(F.split("markdown", "\n\n")), "\n\n")
    made = p.join(marks, ["doc_id", "page"]).where((F.col("doc_id") + F.col("page")) % 3 == 0)
    made = made.select("doc_id", "page", F.lit("visual").alias("kind"), F.when((F.col("doc_id") + F.col("page")) % 5 == 0, "other").otherwise(F.col("fingerprint")).alias("fingerprint"), turned.alias("markdown"), (F.col("doc_id") % 2 == 0).alias("order_only"))
    return quality.route_pages(p, made, p.where((F.col("doc_id") + F.col("page")) % 7 == 0).select("doc_id", "page", F.concat("markdown", F.lit("\nby hand")).alias("markdown")))


#: Characters of a request in the query, so that there are regions on both sides.
QUERY_LIMIT = 1500


def _measured(spark, sf_dir):
    o = outline(spark, sf_dir)
    bare = o.regions.select("doc_id", "region", "region_id", "candidate_ids", "anchors", "outline", "reason", "dependencies", "dependency_edges")
    return o.budget(bare, QUERY_LIMIT).select("doc_id", "region", "actual", "fingerprint", "budget_status")


def _region_rows(spark, sf_dir):
    pair = lambda x: F.concat(x["candidate_id"], F.lit(":"), F.array_join(x["neighbours"], "+"))
    return outline(spark, sf_dir).regions.select(
        "doc_id", "region", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.col("coverage.candidate_count").alias("candidate_count"),
        F.array_join(F.transform("dependencies", pair), ",").alias("dependencies"), F.size("dependency_edges").alias("n_edges"), F.col("coverage.context_characters").alias("context_characters"), "split_status")


def _boundaries(spark, sf_dir):
    o = outline(spark, sf_dir)
    return body.with_boundaries(o.cuts, o.islands).select("doc_id", "page", "start", "n_uncertain", F.array_join("uncertain_boundaries", ",").alias("boundaries"))


#: The request of a region of the plain corpus, key by key; a header line has neither label nor support, and may be below the page before.
_BUDGET = rf"""SELECT doc_id, region, CAST(length(tight) AS INT) AS actual, sha256(regexp_replace(tight, '((?:"(?:[^"\\]|\\.)*"|[^",:])*)([,:])', '\1\2 ', 'g')) AS fingerprint,
    CASE WHEN length(tight) > {QUERY_LIMIT} THEN 'oversized' ELSE 'within_budget' END AS budget_status
FROM (SELECT doc_id, region, CAST(to_json({{
        'anchors': anchors, 'candidate_ids': [candidate_id],
        'candidates': [{{'id': candidate_id, 'label': label, 'label_grammar': label_grammar, 'markdown_level': markdown_level, 'original_text': raw, 'page': page,
            'ranges': [{{'end': "end", 'page': page, 'revision': revision, 'start': start}}], 'signals': signals, 'title': title}}],
        'compressed_outline': outline,
        'context': [{{'end': least(length(markdown), "end" + 200), 'page': page, 'start': 0, 'text': substr(markdown, 1, least(length(markdown), "end" + 200)::INT)}}],
        'document_hash': document_hash,
        'evidence': [{{'candidate_id': candidate_id, 'conflicts': []::VARCHAR[], 'label_interpretations': []::VARCHAR[], 'markdown_level': markdown_level, 'numeric_level': NULL, 'possible_parents': list_concat(['root'], anchors),
            'selected_label': NULL, 'sequence_peers': []::VARCHAR[], 'signals': signals, 'support': []::VARCHAR[]}}],
        'revision': revision}}) AS VARCHAR) AS tight
    FROM (SELECT k.*, f.region, p.markdown, p.document_hash, rev.revision,
            coalesce((SELECT list(node_id ORDER BY ord) FROM sections s WHERE s.doc_id = f.doc_id AND s.page = f.page - 1 AND (depth = 1 OR s.label LIKE '%.2')), []::VARCHAR[]) AS anchors,
            (SELECT list({{'context_only': s.page = f.page, 'id': node_id, 'label': label, 'parent_id': parent_id, 'title': title}} ORDER BY ord) FROM sections s
                WHERE s.doc_id = f.doc_id AND ((s.page = f.page - 1 AND (depth = 1 OR s.label LIKE '%.2')) OR (s.page = f.page AND depth = 1))) AS outline
        FROM found f JOIN c k ON k.doc_id = f.doc_id AND k.candidate_id = f.candidate_id JOIN pages p ON p.doc_id = f.doc_id AND p.page = f.page JOIN rev ON rev.doc_id = f.doc_id))"""

_ACCEPT = "(p.table_count = 0 OR contains(p.markdown, '|')) AND p.plain_text <> ''"
_X = "(p.doc_id + p.page)"

_DECISION_QUERIES = {
    "decide": (_decisions, "SELECT doc_id, ord, candidate_id, role, parent_id, status, reasons FROM d"),
    "dependency_edges": (lambda s, d: decisions.dependency_edges(outline(s, d, False).decided).select("doc_id", "candidate_id", "depends_on"), None),
    "dependency_regions": (_regions, """SELECT f.doc_id, f.region, f.candidate_id AS candidate_ids, CASE WHEN f.page = 1 THEN '' ELSE (SELECT string_agg(node_id, ',' ORDER BY ord) FROM sections s WHERE s.doc_id = f.doc_id AND s.page = f.page - 1 AND (depth = 1 OR s.label LIKE '%.2')) END AS anchors,
        (SELECT count(*) FROM sections s WHERE s.doc_id = f.doc_id AND ((s.page = f.page - 1 AND (depth = 1 OR s.label LIKE '%.2')) OR (s.page = f.page AND depth = 1))) AS n_outline, 'ISOLATED_AMBIGUITY' AS reason FROM found f"""),
    "region_context": (lambda s, d: decisions.region_context(outline(s, d).regions, outline(s, d).candidates, outline(s, d).pages), """SELECT f.doc_id, f.region, f.page, 0 AS start, least(length(markdown), f."end" + 200)::INT AS "end", substr(markdown, 1, least(length(markdown), f."end" + 200)::INT) AS text FROM found f JOIN pages p ON p.doc_id = f.doc_id AND p.page = f.page"""),
    "region_budget": (_measured, _BUDGET),
    "region_rows": (_region_rows, """SELECT doc_id, region, CAST(page AS VARCHAR) AS pages, 1 AS candidate_count, candidate_id || ':' AS dependencies, 0 AS n_edges, least(length(markdown), "end" + 200)::INT AS context_characters, 'not_needed' AS split_status FROM (SELECT f.*, markdown FROM found f JOIN pages p ON p.doc_id = f.doc_id AND p.page = f.page)"""),
    "validate_responses": (lambda s, d: _replied(s, d)[1].select("doc_id", "region", _flat("errors")), f"SELECT doc_id, region, CASE WHEN doc_id % 4 <> 3 AND doc_id % 5 <> 2 AND doc_id % 3 = 1 THEN 'unknown or duplicate candidate' ELSE '' END AS errors FROM found"),
    "apply_responses": (lambda s, d: _replied(s, d)[0].select("doc_id", "candidate_id", "role", "status", "origin"), f"SELECT doc_id, candidate_id, CASE WHEN kind = 'open' AND {_REPLY} = 'returned' THEN 'body' ELSE role END AS role, CASE WHEN kind = 'open' AND {_REPLY} = 'returned' THEN 'RESOLVED' ELSE status END AS status, CASE WHEN kind = 'open' AND {_REPLY} = 'returned' THEN 'fixture_replay' ELSE 'deterministic' END AS origin FROM d"),
    "assemble_hierarchy": (lambda s, d: outline(s, d).tree.select("doc_id", "node_id", "parent_id", "depth", "label", "title"), "SELECT doc_id, node_id, parent_id, depth, label, title FROM nodes"),
    "section_index": (lambda s, d: outline(s, d).section_index.select("doc_id", "candidate_id", "parent_id"), "SELECT doc_id, node_id AS candidate_id, parent_id FROM sections"),
    "ambiguity_summary": (lambda s, d: decisions.ambiguity_summary(outline(s, d).decided, outline(s, d).regions).select("doc_id", "role_uncertain", "parent_uncertain", "regions", F.array_join(F.col("region_sizes").cast("array<string>"), ",").alias("sizes")), "SELECT doc_id, count(*) FILTER (kind = 'open') AS role_uncertain, count(*) FILTER (kind = 'open') AS parent_uncertain, count(*) FILTER (kind = 'open') AS regions, coalesce(string_agg('1', ',') FILTER (kind = 'open'), '') AS sizes FROM c GROUP BY doc_id"),
    "body_segments": (lambda s, d: outline(s, d).segments.select("doc_id", "page", "start", "end", "status", "text"), 'SELECT doc_id, page, start, "end", status, substr(markdown, start + 1, "end" - start) AS text FROM segments'),
    "segment_owner": (lambda s, d: outline(s, d).cuts.select("doc_id", "page", "start", "owner"), "SELECT doc_id, page, start, owner FROM segments"),
    "segment_uncertainty": (lambda s, d: outline(s, d).cuts.select("doc_id", "page", "start", _flat("ownership_reasons"), "ownership"), "SELECT doc_id, page, start, CASE WHEN provisional THEN 'AMBIGUOUS_HEADING_BOUNDARY' ELSE '' END AS ownership_reasons, CASE WHEN provisional THEN 'provisional' ELSE 'source_sliced' END AS ownership FROM segments"),
    "uncertain_boundaries": (_boundaries, """SELECT g.doc_id, g.page, g.start, CAST(count(f.openid) AS INT) AS n_uncertain, coalesce(string_agg(f.openid, ',' ORDER BY f.page, f.start), '') AS boundaries
        FROM segments g LEFT JOIN segments f ON f.doc_id = g.doc_id AND f.island = g.island AND f.openid IS NOT NULL AND (f.page < g.page OR (f.page = g.page AND f.start <= g.start)) GROUP BY g.doc_id, g.page, g.start"""),
    "page_separators": (lambda s, d: outline(s, d).cuts.where("separator_before <> ''").select("doc_id", "page", "start", "owner"), "SELECT doc_id, page, start, owner FROM segments WHERE start = 0 AND page > 1"),
    "scope_events": (lambda s, d: outline(s, d).cuts.where("status = 'HEADING'").select("doc_id", "page", "start", F.array_join("scope_path", "/").alias("path"), F.size("closed").alias("n_closed"), F.size("opened").alias("n_opened")), "SELECT doc_id, page, start, CASE depth WHEN 1 THEN 'root/' || node_id ELSE 'root/' || parent_id || '/' || node_id END AS path, CASE WHEN depth = 2 THEN CASE WHEN label LIKE '%.2' THEN 1 ELSE 0 END WHEN page = 1 THEN 0 ELSE 2 END AS n_closed, 1 AS n_opened FROM sections"),
    "own_text": (lambda s, d: outline(s, d).nodes.select("doc_id", "node_id", "text"), "SELECT doc_id, node_id, text FROM nodes"),
    "body_index": (lambda s, d: outline(s, d).body_index.select("doc_id", "node_id", "source_characters", F.col("export_characters").cast("long").alias("export_characters"), "generated_page_separators", F.size("heading_ranges").alias("headings"), "verified"), "SELECT doc_id, node_id, length(text) - separators AS source_characters, length(text) AS export_characters, separators AS generated_page_separators, CASE WHEN node_id = 'root' THEN 0 ELSE 1 END AS headings, false AS verified FROM nodes"),
    "source_accounting": (lambda s, d: outline(s, d, False).accounting, "SELECT doc_id, page, length(markdown) AS covered, length(markdown) AS canonical, 0 AS breaks FROM pages", False),
    "validate_spans": (lambda s, d: checks.validate_spans(_tampered(outline(s, d).segments), outline(s, d).pages, outline(s, d).tree, outline(s, d).revisions).select("doc_id", "reason", "page", "start"), "SELECT doc_id, CASE page % 4 WHEN 0 THEN 'SOURCE_TEXT_MISMATCH' WHEN 1 THEN 'STALE_SOURCE_REVISION' WHEN 2 THEN 'UNKNOWN_BODY_OWNER' ELSE 'INVALID_SOURCE_SPAN' END AS reason, page, start FROM segments WHERE start = 0"),
    "validate_own_text": (lambda s, d: checks.validate_own_text(outline(s, d).segments, outline(s, d).nodes.withColumn("text", F.when(F.col("label").endswith(".1"), F.concat("text", F.lit("!"))).otherwise(F.col("text")))).select("doc_id", "reason", "id"), "SELECT doc_id, 'OWN_TEXT_MISMATCH' AS reason, node_id AS id FROM sections WHERE label LIKE '%.1'"),
    "document_status": (lambda s, d: outline(s, d).status, f"SELECT doc_id, (SELECT count(*) FROM found f WHERE f.doc_id = n.doc_id) AS pending, (SELECT count(*) FROM segments g WHERE g.doc_id = n.doc_id AND provisional) AS outstanding_ownership, 0 AS extraction_failures, last - 1 AS generated_page_separators, 0 AS source_errors, (SELECT count(*) FROM pages p WHERE p.doc_id = n.doc_id AND NOT ({_ACCEPT})) AS unresolved_extraction, last >= 3 AS structural_complete, last >= 3 AND (SELECT count(*) FROM pages p WHERE p.doc_id = n.doc_id AND NOT ({_ACCEPT})) = 0 AS complete FROM n_pages n"),
    "evidence_outline": (lambda s, d: outline(s, d, False).summary(_metadata(outline(s, d, False).given)), None),
    "corpus_summary": (lambda s, d: outline(s, d).summary(_metadata(outline(s, d).given)), f"""SELECT n.doc_id, last AS pages, (SELECT count(*) FROM c WHERE c.doc_id = n.doc_id) AS candidates, (SELECT count(*) FROM sections x WHERE x.doc_id = n.doc_id) AS accepted_sections, (SELECT count(*) FROM found f WHERE f.doc_id = n.doc_id) AS ambiguous_candidates, (SELECT count(*) FROM found f WHERE f.doc_id = n.doc_id) AS regions, 0 AS source_errors,
        (SELECT string_agg(CASE WHEN p.plain_text = '' THEN 'UNVERIFIABLE' WHEN {_ACCEPT} THEN 'ACCEPT' ELSE 'NEEDS_VISUAL' END, ',' ORDER BY page) FROM pages p WHERE p.doc_id = n.doc_id) AS page_statuses, CASE WHEN n.doc_id % 2 = 0 THEN 'ai_unreviewed' ELSE 'reviewed' END AS annotation_status FROM n_pages n"""),
    "fingerprint": (lambda s, d: quality.page_request(outline(s, d).pages, outline(s, d).revisions).groupBy("doc_id").agg(F.count_distinct("fingerprint").alias("n")), "SELECT doc_id, last AS n FROM n_pages"),
    "route_pages": (lambda s, d: _proposed(s, d)["repairs"].select("doc_id", "page", "status", "reason", "adopted"), f"""SELECT p.doc_id, p.page, CASE WHEN {_ACCEPT} THEN 'skipped' WHEN {_X} % 3 <> 0 THEN 'unavailable' WHEN {_X} % 5 = 0 THEN 'rejected' ELSE 'returned' END AS status, CASE WHEN {_ACCEPT} THEN 'ACCEPT' WHEN {_X} % 3 <> 0 THEN 'no proposal' WHEN {_X} % 5 = 0 THEN 'REPLAY_FINGERPRINT_MISMATCH' END AS reason,
        NOT ({_ACCEPT}) AND {_X} % 3 = 0 AND {_X} % 5 <> 0 AND p.doc_id % 2 = 0 AS adopted FROM pages p"""),
    "repaired_pages": (lambda s, d: _proposed(s, d)["pages"].select("doc_id", "page", "markdown"), f"""SELECT p.doc_id, p.page, CASE WHEN {_X} % 7 = 0 THEN p.markdown || chr(10) || 'by hand' WHEN NOT ({_ACCEPT}) AND {_X} % 3 = 0 AND {_X} % 5 <> 0 AND p.doc_id % 2 = 0 THEN array_to_string(list_reverse(string_split(p.markdown, chr(10) || chr(10))), chr(10) || chr(10)) ELSE p.markdown END AS markdown FROM pages p"""),
}


def _tampered(segments):
    first = F.col("start") == 0
    kind = F.col("page") % 4
    return segments.withColumns({
        "text": F.when(first & (kind == 0), "changed").otherwise(F.col("text")), "revision": F.when(first & (kind == 1), "old").otherwise(F.col("revision")),
        "owner": F.when(first & (kind == 2), "nobody").otherwise(F.col("owner")), "end": F.when(first & (kind == 3), 10**9).otherwise(F.col("end"))})


def _metadata(pages):
    return pages.select("doc_id").distinct().withColumn("annotation_status", F.when(F.col("doc_id") % 2 == 0, "ai_unreviewed").otherwise("reviewed"))


# ---- Evaluation against an altered copy of the plain corpus' own tree.
def _references(o, texts=False):
    """Reference trees: every `p.2` section retitled, every `p.1` section's text changed; without texts for those who do not read them."""
    lost, changed = F.col("label").endswith(".2"), F.col("label").endswith(".1")
    n = (o.nodes if texts else o.tree).withColumn("title", F.when(lost, F.concat("title", F.lit(" lost"))).otherwise(F.col("title")))
    if texts:
        n = n.withColumn("text", F.when(changed, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    return n.select("doc_id", F.concat(F.lit("r-"), "node_id").alias("node_id"), F.concat(F.lit("r-"), "parent_id").alias("parent_id"), "ord", "label", "title", *["text"] * texts)


def _alignment(o):
    """Confirmed links of all headings of even documents; of the retitled ones, those of every third document say that the Markdown lacks the heading."""
    d = o.candidates.join(o.tree.select("doc_id", F.col("node_id").alias("candidate_id")), ["doc_id", "candidate_id"]).where("doc_id % 2 = 0")
    lost = F.col("label").endswith(".2") & (F.col("doc_id") % 3 == 0)
    return d.select(
        "doc_id", F.concat(F.lit("r-"), "candidate_id").alias("reference_id"), F.array("page").alias("pages"), F.when(lost, "absent").otherwise(F.col("raw")).alias("heading_text"), F.lit(True).alias("confirmed"),
        F.lit(None).cast("string").alias("canonical_revision"), F.when(lost, F.lit(None)).otherwise(F.col("start")).alias("start"), F.when(lost, "absent").otherwise("present").alias("markdown_presence"), F.lit(True).alias("markdown_presence_confirmed"), F.lit(True).alias("own_text_confirmed"))


def _evaluated(spark, sf_dir):
    o = outline(spark, sf_dir)
    refs, links, rev = _references(o), _alignment(o), o.revisions
    matches = evaluation.align_headings(refs, o.tree, o.candidates, links, rev)
    capture = evaluation.candidate_capture(refs, o.candidates, links, rev, o.pages)
    return o, refs, links, trees.kept_together(matches, "matches"), trees.kept_together(capture, "capture")


def _scores(spark, sf_dir):
    o, refs, links, m, c = _evaluated(spark, sf_dir)
    out = evaluation.evaluation_scores(m, c, evaluation.parent_accuracy(m, refs, o.tree), evaluation.own_text_accuracy(m, _references(o, True), o.nodes, o.cuts, links), o.candidates, o.tree, _metadata(o.given))
    return out.select("doc_id", "comparison", "refs", "suggested", "captured", "confirmed", "parents_right", "parents_seen", "missing_sections", "candidate_recall", "section_recall", "parent_accuracy")


_ITEM = lambda c: f"CASE WHEN {c} < 0 THEN 'root' ELSE 'item-' || {c} END"
_LOST = "(s.label LIKE '%.2' AND s.doc_id % 3 = 0)"
_SURE = f"(s.doc_id % 2 = 0 AND NOT {_LOST})"
#: Which reference headings of odd documents a unique label and title find: those that aren't retitled and not repeated.
_EVALUATION_QUERIES = {
    "align_headings": (lambda s, d: _evaluated(s, d)[3].select("doc_id", "reference_id", "prediction_id", "status"), f"SELECT s.doc_id, 'r-' || s.node_id AS reference_id, CASE WHEN {_SURE} OR (s.doc_id % 2 = 1 AND s.label NOT LIKE '%.2') THEN s.node_id END AS prediction_id, CASE WHEN {_SURE} THEN 'confirmed' ELSE 'needs_manual_alignment' END AS status FROM sections s"),
    "candidate_capture": (lambda s, d: _evaluated(s, d)[4].select("doc_id", "reference_id", "suggested", "candidate_id", "miss", "uncertain"), f"SELECT s.doc_id, 'r-' || s.node_id AS reference_id, s.label NOT LIKE '%.2' AS suggested, CASE WHEN {_SURE} THEN s.node_id END AS candidate_id, CASE WHEN s.doc_id % 2 = 0 AND {_LOST} THEN 'extraction' END AS miss, s.doc_id % 2 = 1 AS uncertain FROM sections s"),
    "attribute_misses": (lambda s, d: evaluation.attribute_misses(*_evaluated(s, d)[3:]), f"SELECT s.doc_id, 'r-' || s.node_id AS reference_id, CASE WHEN s.doc_id % 2 = 0 THEN 'extraction' ELSE 'unclassified' END AS stage FROM sections s WHERE NOT {_SURE}"),
    "parent_accuracy": (lambda s, d: (lambda e: evaluation.parent_accuracy(e[3], e[1], e[0].tree))(_evaluated(s, d)), f"SELECT s.doc_id, 'r-' || s.node_id AS reference_id, true AS correct FROM sections s WHERE {_SURE}"),
    "own_text_accuracy": (lambda s, d: (lambda e: evaluation.own_text_accuracy(e[3], _references(e[0], True), e[0].nodes, e[0].cuts, e[2]))(_evaluated(s, d)), f"SELECT s.doc_id, 'r-' || s.node_id AS reference_id, s.label NOT LIKE '%.1' AS exact, s.label NOT LIKE '%.1' AS normalized FROM sections s WHERE {_SURE} AND NOT EXISTS (SELECT 1 FROM segments g WHERE g.doc_id = s.doc_id AND g.owner = s.node_id AND provisional AND g.status = 'ASSIGNED')"),
    "evaluation_scores": (_scores, f"""SELECT *, CASE WHEN doc_id % 2 = 0 AND refs > 0 THEN captured / refs END AS candidate_recall, CASE WHEN doc_id % 2 = 0 AND refs > 0 THEN confirmed / refs END AS section_recall, CASE WHEN doc_id % 2 = 0 AND parents_seen > 0 THEN parents_right / parents_seen END AS parent_accuracy FROM (SELECT s.doc_id, CASE WHEN s.doc_id % 2 = 0 THEN 'against AI draft reference' ELSE 'against reviewed golden' END AS comparison, count(*) AS refs, count(*) FILTER (s.label NOT LIKE '%.2') AS suggested, count(*) FILTER ({_SURE}) AS captured, count(*) FILTER ({_SURE}) AS confirmed,
        count(*) FILTER ({_SURE}) AS parents_right, count(*) FILTER ({_SURE}) AS parents_seen, count(*) FILTER (NOT {_SURE}) AS missing_sections FROM sections s GROUP BY s.doc_id)"""),
    "match_runs_to_references": (lambda s, d: _paired(s, d), "SELECT doc_id AS run_id, doc_id AS reference_id FROM n_pages WHERE doc_id % 3 <> 0"),
    "comparable_runs": (lambda s, d: (lambda p: evaluation.comparable_runs(p, p.where("doc_id % 3 > 0 or page > 1")))(outline(s, d).given.select("doc_id", "document_hash", "page"))[1], "SELECT doc_id, 'runs must have one source hash and the same pages' AS error FROM n_pages WHERE doc_id % 3 = 0"),
    "page_changes": (lambda s, d: (lambda p: evaluation.page_changes(p, p.withColumn("markdown", F.when(F.col("page") % 2 == 0, F.concat("markdown", F.lit("!"))).otherwise(F.col("markdown")))))(outline(s, d).given), "SELECT doc_id, page, markdown AS automatic, markdown || '!' AS manual FROM pages WHERE page % 2 = 0"),
    "reference_intake": (lambda s, d: _intake(s, d), "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 7 = 1 THEN 'source hash changed' END, CASE WHEN last > 6 THEN 'only the first six pages' END, CASE WHEN doc_id % 5 = 0 THEN 'taken in before' END, CASE WHEN doc_id % 11 = 3 THEN 'model missing' END) AS errors FROM n_pages WHERE doc_id % 7 = 1 OR last > 6 OR doc_id % 5 = 0 OR doc_id % 11 = 3"),
    "raw_text_outline": (lambda s, d: raw_text.raw_text_outline(_raw(s, d)).select("doc_id", "node_id", "parent_id", "label", "title", "text"), f"""SELECT p.doc_id, {_ITEM('p.line')} AS node_id, {_ITEM('parent')} AS parent_id, label, title, coalesce(t.text, '') AS text FROM rp p LEFT JOIN rt2 t ON t.doc_id = p.doc_id AND t.owner = p.line
        UNION ALL SELECT r.doc_id, 'root', NULL, '', '', coalesce(nullif({strip("coalesce(t.text, '')")}, ''), 'seed') FROM rt r LEFT JOIN rt2 t ON t.doc_id = r.doc_id AND t.owner = -1"""),
    "raw_text_headings": (lambda s, d: raw_text.raw_lines(_raw(s, d)).where("heading").select("doc_id", "line", "label", "title", "level"), "SELECT doc_id, line, label, title, level FROM rh WHERE heading"),
    "validate_trees": (lambda s, d: trees.validate_trees(_broken_trees(s, d)).select("doc_id", "error"), "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'expected exactly a root' WHEN 1 THEN 'unexpected or missing fields' WHEN 2 THEN 'title must be a string' WHEN 3 THEN 'wrong depth' END AS error FROM documents WHERE doc_id % 5 <> 4"),
}


_RAW = rf""",
rt AS (SELECT doc_id, string_agg(markdown, chr(10) || chr(10) ORDER BY page) AS text FROM pages GROUP BY doc_id),
rl AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, regexp_replace(unnest(string_split(text, chr(10))), '[{WS}]+$', '') AS text FROM rt),
rm AS (SELECT *, regexp_extract(text, '{raw_text.MARKED}', 1) AS marks, CASE WHEN regexp_matches(text, '{raw_text.MARKED}') THEN {strip(f"regexp_extract(text, '{raw_text.MARKED}', 2)")} ELSE text END AS rest FROM rl),
rn AS (SELECT *, regexp_replace(regexp_extract(rest, '{raw_text.NUMBERED}', 1), '[.)]$', '') AS own, regexp_extract(rest, '{raw_text.NUMBERED}', 2) AS after, regexp_matches(rest, '{raw_text.NUMBERED}') AS labelled FROM rm),
rh AS (SELECT doc_id, line, text, marks <> '' OR labelled AS heading, CASE WHEN labelled THEN own WHEN marks <> '' THEN CAST(length(marks) AS VARCHAR) END AS label, CASE WHEN labelled AND marks <> '' THEN after WHEN labelled THEN {strip('after')} WHEN marks <> '' THEN rest END AS title,
    CASE WHEN marks <> '' THEN length(marks) WHEN labelled THEN 1 + length(own) - length(replace(own, '.', '')) + CASE WHEN contains(own, '(') THEN 1 ELSE 0 END END AS level FROM rn),
ro AS (SELECT *, coalesce(last_value(CASE WHEN heading THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line), -1) AS owner FROM rh),
rb AS (SELECT *, bool_or(text <> '') OVER (PARTITION BY doc_id, owner ORDER BY line) AS begun FROM ro WHERE NOT heading AND (text <> '' OR owner >= 0)),
rt2 AS (SELECT doc_id, owner, string_agg(text, chr(10) ORDER BY line) AS text FROM rb WHERE begun GROUP BY ALL),
rp AS (SELECT *, greatest({', '.join(f"CASE WHEN level > {k} THEN max(CASE WHEN level = {k} THEN line END) OVER b END" for k in range(1, 13))}, -1) AS parent FROM rh WHERE heading WINDOW b AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _paired(spark, sf_dir):
    p = outline(spark, sf_dir).given.groupBy("doc_id").agg(F.max("document_hash").alias("document_hash"), F.sort_array(F.collect_list("page")).alias("selected_pages"))
    refs = p.withColumn("selected_pages", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(0))).otherwise(F.col("selected_pages")))
    return evaluation.match_runs_to_references(p.withColumnRenamed("doc_id", "run_id"), refs.withColumnRenamed("doc_id", "reference_id"))[0]


def _intake(spark, sf_dir):
    o = outline(spark, sf_dir)
    doc = F.col("doc_id")
    packets = o.given.groupBy("doc_id").agg(F.sort_array(F.collect_list("page")).alias("selected_pages"), F.max("document_hash").alias("document_hash"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "plain_text"))), lambda x: x["plain_text"]), "\n").alias("text"))
    metadata = packets.select("doc_id", "selected_pages", F.when(doc % 7 == 1, "old").otherwise(F.col("document_hash")).alias("source_sha256"), F.lit("draft").alias("annotation_status"))
    drafts = packets.select("doc_id", F.when(doc % 11 == 3, "").otherwise("model").alias("model"), F.lit("notes").alias("notes"))
    none = spark.createDataFrame([], "doc_id long")
    return checks.reference_intake(drafts, metadata, packets.select("doc_id", "document_hash", "text"), none, o.nodes, packets.where(doc % 5 == 0))[1].select("doc_id", _flat("errors"))


def _raw(spark, sf_dir):
    """Each document's derived pages as one text."""
    p = corpus.corpus(spark, sf_dir)["pages"]
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "markdown"))), lambda x: x["markdown"]), "\n\n").alias("text"))


def _broken_trees(spark, sf_dir):
    """A tree of each document's text, with one fault by its id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 5
    node = F.to_json(F.struct(F.lit("root").alias("id"), F.lit("").alias("label"), F.lit("T").alias("title"), text.alias("text"), F.when(k == 3, 1).otherwise(0).alias("depth"), F.array().cast("array<string>").alias("children")))
    node = F.when(k == 1, F.regexp_replace(node, r"^\{", '{"more":1,')).when(k == 2, F.regexp_replace(node, '"title":"T"', '"title":null')).otherwise(node)
    return docs.select("doc_id", F.concat(F.lit('{"root":'), node, F.when(k == 0, ',"other":1}').otherwise("}")).alias("tree"))


QUERIES = {k: v[0] for k, v in {**_BLOCK_QUERIES, **_DECISION_QUERIES, **_EVALUATION_QUERIES}.items()}
ORACLES = {
    **{k: sql(v[1]) for k, v in _BLOCK_QUERIES.items()},
    **{k: sql(v[1], more=_RAW if k.startswith("raw_text") else "") if len(v) > 2 or k.startswith("raw_text") else _plain(v[1]) for k, v in {**_DECISION_QUERIES, **_EVALUATION_QUERIES}.items() if v[1]},
}
