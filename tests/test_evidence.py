"""The evidence outline on small documents with known outcomes, and its fold, cutting and hierarchy against plain loops."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from outline_jobs.functions import canonical, slices
from outline_jobs.operators import blocks, body, checks, decisions
from outline_jobs.plans.evidence_outline import EvidenceOutline

PAGE = "doc_id long, page int, markdown string, plain_text string, blocks array<array<double>>, table_count int, document_hash string, extraction_status string"
P = "The committee keeps a full record of every matter that it has heard in the past year."


def pages(spark, docs):
    """docs: doc_id -> texts of pages, or (page, text)."""
    rows = [(d, *((k + 1, t) if isinstance(t, str) else t)) for d, texts in docs.items() for k, t in enumerate(texts)]
    return spark.createDataFrame([(d, n, t, t, [], 0, f"h{d}", "extracted") for d, n, t in rows], PAGE)


CASES = {
    1: ["Letterhead\n\n## Decorative title\n\n# **I. Scope**\n\nScope body.\n\n# **II. Requirements**\n\nParent own text.", "# **A. First child**\n\nFirst child body.\n\n# **B. Second child**\n\nMore."],
    2: [f"# I. Overview\n\n# A. Single child\n\n{P}\n\n# II. Rules"],
    3: ["# A. Isolated\n\nSome text."],
    4: ["\n\n".join(f"# {k} Item {k}\n\nBody {k} ends." for k in range(1, 10))],
    5: ["1\n\nText.", "2\n\nText.", "9\n\nText."],
    6: ["## (i) Isolated heading\n\nSome body."],
    7: ["# 1 Parent\n\n**Possible enclosing section**\n\n### 1.1.1 Child"],
    8: ["# 1 First\n\n# 2 Second\n\n## 1.1 Late child of first"],
    9: [f"# Scope\n\n{P}\n\n# Requirements\n\n{P}\n\n> Short quoted text"],
    10: ["# IV. Fourth\n\n# V. Fifth"],
    11: [f"ACME rules\n\n# **I. One**\n\n{P}\n\n# **II. Two**\n\n{P}", f"ACME rules\n\n# **A. First**\n\n{P}\n\n# **B. Second**\n\n{P}", f"ACME rules\n\n# **C. Third**<sup>**<u>iv</u>**</sup>\n\n{P}"],
    13: ["# I. Part\n\n# A. One\n\n# 1 Top\n\n# 1.1 Sub\n\n# 1.1.1 Deep\n\n# 1.2 Next\n\n# 2 Second\n\n# B. Two\n\n# II. End"],
    14: ["# 1 First\n\n# 2 Second\n\n# 1 Restart"],
    15: ["# I. Part\n\n# A. One\n\n# 1 First\n\n# B. Two\n\n# 2 Missing restart\n\n# II. Next"],
    16: ["# 1 Scope\n\n1. First task\n2. Second task\n\n# 2 Duties\n\n1. Separate task\n\n2. Another task"],
    17: ["# 1 Scope\nOwn body text on next line.\n## **1.1 Wrapped\nheading**\nChild body on next line."],
    18: ["```\n# 1 Code example\n```"],
    19: ["# 1 Scope\n\nword", "continuation"],
    20: [(1, "# 1 Scope\n\nInitial body."), (3, "continued here.")],
    21: ["# 1 A\n\nx y.\n\n## 1.1 B\n\nx y.\n\n## 1.2 C\n\nx y.\n\n# 2 D\n\nx y."],
    23: ["bad � sign.", ""],
    30: ["", "# 1 Scope\n\nText."],
}


@pytest.fixture(scope="module")
def run(spark):
    return EvidenceOutline(pages(spark, CASES))


@pytest.fixture(scope="module")
def tree(run):
    out = {}
    rows = run.nodes.collect()
    names = {(r["doc_id"], r["node_id"]): (r["label"] or r["title"]) for r in rows}
    for r in sorted(rows, key=lambda r: r["ord"]):
        if r["parent_id"] is not None:
            out.setdefault(r["doc_id"], []).append((names[r["doc_id"], r["parent_id"]], r["label"] or r["title"], r["text"]))
    return out


@pytest.fixture(scope="module")
def decided(run):
    rows = run.decisions.join(run.candidates.select("doc_id", "candidate_id", "label", "title"), ["doc_id", "candidate_id"]).orderBy("doc_id", "ord").collect()
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def edges(tree, d):
    return [(a, b) for a, b, _ in tree.get(d, [])]


def test_sections(tree, decided):
    assert edges(tree, 1) == [("", "I."), ("", "II."), ("II.", "A."), ("II.", "B.")] and "First child" not in tree[1][1][2]
    assert edges(tree, 2) == [("", "I."), ("I.", "A."), ("", "II.")] and P in tree[2][1][2]
    assert decided[3][0]["role_uncertain"] and not edges(tree, 3)
    assert edges(tree, 4) == [("", str(k)) for k in range(1, 10)]
    assert not edges(tree, 5) and {r["role"] for r in decided[5]} == {"body"}
    assert decided[6][0]["status"] == "AMBIGUOUS" and decided[6][0]["label"] == "(i)"
    assert edges(tree, 7) == [("", "1")] and decided[7][-1]["status"] == "AMBIGUOUS" and "PARENT_UNCERTAIN" in decided[7][-1]["reasons"]
    assert decided[8][-1]["status"] == "AMBIGUOUS" and "NUMBERED_SCOPE_CONFLICT" in decided[8][-1]["reasons"]
    assert edges(tree, 9) == [("", "Scope"), ("", "Requirements")] and (decided[9][-1]["role"], decided[9][-1]["status"]) == ("body", "RESOLVED")
    assert [(r["role"], r["parent_uncertain"]) for r in decided[10]] == [("section", True)] * 2 and not edges(tree, 10)
    assert edges(tree, 11) == [("", "I."), ("", "II."), ("II.", "A."), ("II.", "B."), ("II.", "C.")] and decided[11][-1]["title"] == "Third"
    assert edges(tree, 13) == [("", "I."), ("I.", "A."), ("A.", "1"), ("1", "1.1"), ("1.1", "1.1.1"), ("1", "1.2"), ("A.", "2"), ("I.", "B."), ("", "II.")]
    assert decided[14][-1]["status"] == "AMBIGUOUS" and "NUMERIC_RESTART_WITHOUT_NEW_SCOPE" in decided[14][-1]["reasons"]
    odd = next(r for r in decided[15] if r["title"] == "Missing restart")
    assert "NUMERIC_START_UNANCHORED" in odd["reasons"] and odd["parent_uncertain"]
    assert edges(tree, 16) == [("", "1"), ("", "2")] and "2. Second task" in tree[16][0][2]
    assert [(r["title"]) for r in decided[17] if r["role"] == "section"] == ["Scope", "Wrapped\nheading"] and [t.strip() for *_, t in tree[17]] == ["Own body text on next line.", "Child body on next line."]
    assert not edges(tree, 18)


def test_body(run, tree):
    assert tree[19][0][2] == "\n\nword\ncontinuation"
    index = {(r["doc_id"], r["label"]): r for r in run.body_index.collect()}
    for r in index.values():
        assert r["export_characters"] == r["source_characters"] + r["generated_page_separators"]
    assert index[19, "1"]["generated_page_separators"] == 1 and index[20, "1"]["ownership"] == "provisional"
    rows = run.segments.orderBy("doc_id", "page", "start").collect()
    assert {x for r in rows if r["doc_id"] == 20 for x in r["ownership_reasons"]} == {"UNSELECTED_PAGE_GAP"}
    name = {r["node_id"]: r["label"] for r in run.nodes.collect()}
    assert [[name[x] for x in r["closed"]] for r in rows if r["doc_id"] == 21 and r["status"] == "HEADING"] == [[], [], ["1.1"], ["1.2", "1"]]
    whole = {}
    for r in rows:
        whole[r["doc_id"], r["page"]] = whole.get((r["doc_id"], r["page"]), "") + r["text"]
    assert whole == {(d, k + 1 if isinstance(t, str) else t[0]): s for d, ts in CASES.items() for k, t in enumerate(ts) if (s := t if isinstance(t, str) else t[1])}


def test_checks(spark, run):
    assert run.source_errors.collect() == []
    status = {r["doc_id"]: r for r in run.status.collect()}
    assert status[4]["complete"] and not status[3]["complete"] and status[23]["structural_complete"] and not status[23]["complete"]
    assert {(r["page"], r["status"]) for r in run.assessments.where("doc_id = 23").collect()} == {(1, "NEEDS_VISUAL"), (2, "UNVERIFIABLE")}
    s = run.segments
    first = (F.col("doc_id") == 4) & (F.col("page") == 1) & (F.col("start") == 0)
    bad = lambda c, v, when=first: s.withColumn(c, F.when(when, v).otherwise(F.col(c)))
    reasons = lambda d: {r["reason"] for r in checks.validate_spans(d, run.pages, run.nodes, run.revisions).collect()}
    assert reasons(bad("text", F.lit("changed"))) == {"SOURCE_TEXT_MISMATCH"} and reasons(bad("revision", F.lit("old"))) == {"STALE_SOURCE_REVISION"}
    assert reasons(bad("owner", F.lit("nobody"))) == {"UNKNOWN_BODY_OWNER"} and reasons(bad("end", F.lit(10**6))) == {"INVALID_SOURCE_SPAN"}
    own = {r["reason"] for r in checks.validate_own_text(bad("separator_before", F.lit("\n")), run.nodes).collect()}
    assert own == {"INVALID_GENERATED_SEPARATOR"}
    cut = checks.accounting_errors(checks.source_accounting(s.where(~first), run.pages))
    assert {r["reason"] for r in cut.collect()} == {"GAP_OR_DUPLICATE_ASSIGNMENT"}
    last = checks.accounting_errors(checks.source_accounting(s.where("not (doc_id = 18)"), run.pages))
    assert {r["reason"] for r in last.collect()} == {"UNCOVERED_TEXT"}


def test_decisions_do_not_depend_on_row_order(spark, run):
    again = decisions.decide(run.evidence.repartition(7, "candidate_id")).collect()
    assert sorted(map(str, again)) == sorted(map(str, run.decided.collect()))


def test_spans_lose_nothing():
    r = random.Random(3)
    parts = ["# 1 A", "##", "## **b", "c** d", "text", "", " ", "```", "~~~x", "####### no", "  # in", "**x**", "#"]
    for _ in range(3000):
        t = "\n".join(r.choices(parts, k=r.randrange(12)))
        spans = blocks.page_spans(t)
        assert all(t[a:b] == t[a:b].strip() != "" for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        left = list(t)
        for a, b, _ in spans:
            left[a:b] = [" "] * (b - a)
        assert not "".join(left).strip()
    assert blocks.page_spans(None) == []


def test_hierarchy(spark):
    c = spark.createDataFrame([(1, i, x, x, "") for i, x in enumerate("abcdefg")], "doc_id long, ord long, candidate_id string, label string, title string")
    d = [("a", "root"), ("b", "c"), ("c", "b"), ("d", "b"), ("e", "f"), ("f", "root"), ("g", "a"), ("g", "root"), ("x", "root")]
    rows = [(1, i, x, p, "RESOLVED", "section") for i, (x, p) in enumerate(d)]
    nodes, errors = decisions.assemble_hierarchy(c, spark.createDataFrame(rows, "doc_id long, ord long, candidate_id string, parent_id string, status string, role string"), c)
    assert {(r["node_id"], r["depth"]) for r in nodes.collect()} == {("root", 0), ("a", 1), ("f", 1), ("g", 2)}
    assert sorted((r["node_id"], r["reason"]) for r in errors.collect()) == [
        ("b", "CYCLE"), ("c", "CYCLE"), ("d", "CYCLE"), ("e", "MISSING_OR_LATER_PARENT"), ("g", "UNKNOWN_OR_DUPLICATE_SECTION_ID"), ("x", "UNKNOWN_OR_DUPLICATE_SECTION_ID")]


def test_replies(spark):
    texts = {1: ["# 1 Parent\n\n**Open section**\n\n### 1.1.1 Child"]}
    first = EvidenceOutline(pages(spark, texts))
    region = first.regions.collect()
    assert [(len(r["candidate_ids"]), r["reason"], r["budget_status"]) for r in region] == [(2, "EXPLICIT_POSSIBLE_PARENT_DEPENDENCIES", "within_budget")]
    q, top = region[0], first.decided.where("role = 'section' and status = 'RESOLVED'").first()["candidate_id"]
    a, b = q["candidate_ids"]

    bare = first.regions.select("doc_id", "region", "region_id", "candidate_ids", "anchors", "outline", "reason", "dependencies", "dependency_edges")
    budget = lambda limit: first.budget(bare, limit)
    assert budget(q["actual"]).first()["budget_status"] == "within_budget" and budget(q["actual"] - 1).first()["budget_status"] == "oversized"
    with pytest.raises(ValueError):
        budget(0)
    answers = {
        "right": [(a, "section", top), (b, "section", a)], "part": [(a, "body", None)], "cycle": [(a, "section", b), (b, "section", a)], "inadmissible parent": [(a, "section", "?")],
        "unknown or duplicate candidate": [(a, "body", None)] * 2, "invalid role": [(a, "part", None)], "unresolved parent": [(a, "section", b), (b, "abstain", None)],
        "parent must come before its child": [(a, "section", b), (b, "section", "root")], "kind": [(a, "body", None)], "mark": [(a, "body", None)], "size": [(a, "body", None)], "none": None,
    }
    names = list(answers)
    every = spark.createDataFrame([(k,) for k in range(len(names))], "doc long")
    many = lambda d: d.crossJoin(every).withColumn("doc_id", F.col("doc")).drop("doc")
    regions = many(first.regions).withColumn("budget_status", F.when(F.col("doc_id") == names.index("size"), "oversized").otherwise(F.col("budget_status")))
    replies = [(k, "region-1", "visual" if n == "kind" else "structure", "other" if n == "mark" else q["fingerprint"], x) for k, (n, x) in enumerate(answers.items()) if n != "none"]
    after, told = decisions.apply_responses(many(first.decided), regions, spark.createDataFrame(replies, decisions.RESPONSE))
    told = {names[r["doc_id"]]: r for r in told.collect()}
    got = {(names[r["doc_id"]], r["candidate_id"]): (r["status"], r["parent_id"]) for r in after.collect()}
    assert told["right"]["status"] == "returned" and (got["right", a], got["right", b]) == (("RESOLVED", top), ("RESOLVED", a))
    assert told["part"]["missing"] == [b] and got["part", a][0] == "RESOLVED" and got["part", b][0] == "AMBIGUOUS"
    for n in names[2:]:
        assert got[n, a][0] == got[n, b][0] == "AMBIGUOUS"
    for n in names[2:8]:
        assert told[n]["status"] == "rejected" and n in told[n]["errors"]
    assert [told[n]["status"] for n in names[8:]] == ["rejected", "rejected", "skipped", "unavailable"]


def test_repairs(spark):
    from outline_jobs.operators import quality

    texts = {1: ["one two �", "three", "four � five", "six �"]}
    p = pages(spark, texts)
    prints = {r["page"]: r["fingerprint"] for r in quality.page_request(p, quality.canonical_revision(p)).collect()}
    proposals = [(1, 1, "visual", prints[1], "� two one", True), (1, 3, "visual", "old", "five four", True), (1, 4, "visual", prints[4], "six", True), (1, 2, "visual", prints[2], "x", True)]
    out = quality.route_pages(p, spark.createDataFrame(proposals, "doc_id long, page int, kind string, fingerprint string, markdown string, order_only boolean"), spark.createDataFrame([(1, 4, "by hand")], "doc_id long, page int, markdown string"))
    assert {r["page"]: (r["status"], r["reason"], r["adopted"]) for r in out["repairs"].collect()} == {1: ("returned", None, True), 2: ("skipped", "ACCEPT", False), 3: ("rejected", "REPLAY_FINGERPRINT_MISMATCH", False), 4: ("returned", None, False)}
    assert [r["markdown"] for r in out["pages"].orderBy("page").collect()] == ["� two one", "three", "four � five", "by hand"]
    assert out["overrides"].first()["additions"] == 2
    r = out["revisions"].first()
    assert r["revision"] != r["original_revision"]


def test_canonical_json(spark):
    odd = ["plain", 'quote " and \\ back', "tab\tline\nend", "\x0b\x1f\x01\x7f", "\\u000B as text \x0b", "é 目 😀 /", "", None]
    rows = spark.createDataFrame([(k, x, [x, "b"], k if k % 2 else None) for k, x in enumerate(odd)], "k int, s string, many array<string>, n int")
    for style in (canonical.COMPACT, canonical.SPACED):
        q = canonical.quoted
        one = canonical.object_of({"z": q(F.col("s")), "a": canonical.strings(F.col("many"), style), "n": q(F.col("n"))}, style, {"n": F.col("n").isNotNull()})
        for r in rows.select("*", one.alias("json")).collect():
            value = {"z": r["s"], "a": list(r["many"]), **({} if r["n"] is None else {"n": r["n"]})}
            assert r["json"] == json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(style.comma, style.colon))


def test_requests(spark):
    p = "# 1 Parent\n\n**Open \"section\"**\n\n### 1.1.1 Child\n\nend \x1f é."
    o = EvidenceOutline(pages(spark, {1: [p]}))
    c = o.candidates.orderBy("ord").collect()
    top, a, b = (r["candidate_id"] for r in c)
    revision = o.revisions.first()["revision"]
    named = lambda r: {
        "id": r["candidate_id"], "original_text": r["raw"], "label": r["label"], "title": r["title"], "markdown_level": r["markdown_level"], "page": 1,
        "ranges": [{"revision": revision, "page": 1, "start": r["start"], "end": r["end"]}], "signals": list(r["signals"]), "label_grammar": r["label_grammar"],
    }
    reading = {"family": "numeric", "value": 1, "path": [1, 1, 1], "series": "numeric:bare:[1, 1]"}
    known = lambda r, **more: {"candidate_id": r["candidate_id"], "signals": list(r["signals"]), "markdown_level": r["markdown_level"], "conflicts": [], "sequence_peers": [], **more}
    payload = {
        "candidate_ids": [a, b], "candidates": [named(c[1]), named(c[2])],
        "evidence": [
            known(c[1], numeric_level=None, possible_parents=["root", top], support=[], label_interpretations=[], selected_label=None),
            known(c[2], numeric_level=3, possible_parents=["root", top, a], support=["CONSISTENT_MARKDOWN_NUMBERING"], label_interpretations=[reading], selected_label=reading),
        ],
        "anchors": [top], "context": [{"page": 1, "start": 0, "end": len(p), "text": p}],
        "compressed_outline": [{"id": top, "parent_id": "root", "label": "1", "title": "Parent", "context_only": False}], "document_hash": "h1", "revision": revision,
    }
    r = o.regions.first()
    assert json.loads(r["request"]) == payload
    assert r["request"] == json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")) and r["actual"] == len(r["request"])
    assert r["fingerprint"] == hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    assert r["pages"] == [1] and [(x["candidate_id"], x["neighbours"]) for x in r["dependencies"]] == [(a, [b]), (b, [a])]
    assert [tuple(x) for x in r["dependency_edges"]] == [(b, a, "POSSIBLE_UNRESOLVED_PARENT")]
    assert tuple(r["coverage"]) == (2, len(p), True, False) and (r["limit"], r["split_status"]) == (decisions.REQUEST_MOST, "not_needed")


def test_slices(spark):
    r = random.Random(5)
    texts = {1: "".join(r.choices("aé目😀\n ", k=3 * slices.PART + 17)), 2: "", 3: "x" * slices.PART, 4: None}
    spans = [(1, k, *sorted(r.choices(range(len(texts[k] or "") + 1), k=2)), n) for k in texts for n in range(40)]
    spans += [(1, 1, 0, len(texts[1]), 40), (1, 1, -1, 4, 41), (1, 1, 5, 4, 42), (1, 1, 5, len(texts[1]) + 1, 43), (1, 9, 0, 1, 44), (None, 1, 0, 1, 45), (1, 1, None, 1, 46)]
    p = spark.createDataFrame([(1, k, t) for k, t in texts.items()], "doc_id long, page int, markdown string")
    out = slices.cut(spark.createDataFrame(spans, "doc_id long, page int, start int, end int, n int"), p).collect()
    assert len(out) == len(spans)
    for x in out:
        t = (texts.get(x["page"]) or "") if x["doc_id"] == 1 and x["page"] in texts else None
        inside = t is not None and x["start"] is not None and 0 <= x["start"] <= x["end"] <= len(t)
        assert x["cut"] == (t[x["start"] : x["end"]] if inside else None) and x["page_length"] == (None if t is None else len(t))


def test_boundaries_of_many_open_candidates(spark):
    """20,000 open candidates in one document: the segments hold counts, one list is shared; against a loop over the cuts."""
    n, headings = 20_000, {7_000, 15_000}
    p = spark.createDataFrame([(1, 1, "x" * (2 * n))], "doc_id long, page int, markdown string")
    c = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.format_string("c%05d", "id").alias("candidate_id"), F.lit(1).alias("page"), (2 * F.col("id")).cast("int").alias("start"), (2 * F.col("id") + 1).cast("int").alias("end"), F.col("id").isin(*headings).alias("made"))
    d = c.select("doc_id", "candidate_id", F.when(F.col("made"), "RESOLVED").otherwise("AMBIGUOUS").alias("status"))
    owned = body.segment_owner(body.body_segments(p, c, d, c.where("made").select("doc_id", F.col("candidate_id").alias("node_id"))))
    s, islands = body.segment_uncertainty(owned), body.island_boundaries(owned)
    assert [(r["island"], len(r["boundaries"])) for r in islands.orderBy("island").collect()] == [(0, 7_000), (1, 7_999), (2, 4_999)]
    open_, at = 0, {}
    for k in range(n):
        open_ = 0 if k in headings else open_ + 1
        at[2 * k] = open_
    assert {r["start"]: r["n_uncertain"] for r in s.where("start % 2 = 0 and start < 40000").select("start", "n_uncertain").collect()} == at
    few = body.with_boundaries(s.where("start in (0, 20, 14000, 14008)"), islands).select("start", "uncertain_boundaries").collect()
    assert {r["start"]: r["uncertain_boundaries"] for r in few} == {0: ["c00000"], 20: [f"c{k:05d}" for k in range(11)], 14000: [], 14008: [f"c{k:05d}" for k in range(7001, 7005)]}
