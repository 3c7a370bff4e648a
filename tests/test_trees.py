"""Node tables on a tiny tree."""

import json

from outline_jobs.operators import quality, trees

TREE = {"root": {"id": "root", "label": "", "title": "T", "text": "one two", "depth": 0, "children": [
    {"id": "a", "label": "1", "title": "A", "text": "x", "depth": 1, "children": [{"id": "b", "label": "1.1", "title": " ", "text": "", "depth": 5, "children": []}]},
    {"id": "c", "label": None, "title": "C", "text": "y z", "depth": 1, "children": []}]}}


def flat(spark):
    return trees.flatten_trees(spark.createDataFrame([(1, json.dumps(TREE)), (2, "not json"), (3, None)], "doc_id long, tree string"))


def test_flatten_stats_normalize_patch(spark):
    n = flat(spark)
    assert [(r["node_id"], r["parent_id"], r["true_depth"]) for r in n.orderBy("ord").collect()] == [("root", None, 0), ("a", "root", 1), ("b", "a", 2), ("c", "root", 1)]
    s = trees.tree_stats(n).collect()
    assert [(r["total_nodes"], r["max_depth"], r["word_count"], r["empty_titles"], r["duplicate_ids"], r["depth_issues"]) for r in s] == [(4, 5, 7, 1, 0, 1)]
    m = trees.normalize_nodes(n)
    assert {r["node_id"]: (r["label"], r["depth"]) for r in m.collect()} == {"root": ("", 0), "a": ("1", 1), "b": ("1.1", 2), "c": ("", 1)}
    p = trees.patch_nodes(m, spark.createDataFrame([(1, "c", "9", None)], "doc_id long, node_id string, label string, title string"))
    assert {r["node_id"]: (r["label"], r["title"]) for r in p.collect()}["c"] == ("9", "C")


def test_renumber_prune_nest(spark):
    m = trees.normalize_nodes(flat(spark))
    assert {r["node_id"]: r["label"] for r in trees.renumber_nodes(m).collect()} == {"root": "", "a": "1", "b": "1.1", "c": "2"}
    d = trees.recompute_depths(m)
    left = trees.prune_subtrees(d, spark.createDataFrame([(1, "a"), (1, "root")], "doc_id long, node_id string"))
    assert {r["node_id"] for r in left.collect()} == {"root", "c"}
    nested = json.loads(trees.nest_trees(m).first()["tree"])
    assert [c["id"] for c in nested["root"]["children"]] == ["a", "c"] and list(nested["root"]) == ["id", "label", "title", "text", "depth", "children"]


def test_revision_and_reconcile(spark):
    kind = "doc_id long, document_hash string, page int, markdown string"
    rev = lambda *p: quality.canonical_revision(spark.createDataFrame([(1, "h", *x) for x in p], kind)).first()["revision"]
    assert rev((1, "a"), (2, "b")) == rev((2, "b"), (1, "a")) != rev((1, "b"), (2, "a"))
    rows = [(1, "red blue red green", "green red red blue", True), (2, "Visitors may never enter", "Visitors may enter", True), (3, "one two two", "one two", True), (4, "red blue", "blue red", False)]
    got = quality.reconcile_pages(spark.createDataFrame(rows, "doc_id long, markdown string, proposed string, order_only boolean"), ["doc_id"]).collect()
    assert {r["doc_id"]: (r["omissions"], r["additions"], r["adopted"]) for r in got} == {1: (0, 0, True), 2: (1, 0, False), 3: (1, 0, False), 4: (0, 0, False)}


def test_faults_and_deep_trees(spark):
    deep = '{"root":' + '{"id":"x","children":[' * 60_000 + "]}" * 60_000 + "}"
    node = {"id": "r", "label": "", "title": "", "text": "", "depth": 0, "children": []}
    trees_ = [(1, json.dumps(TREE)), (2, "not json"), (3, None), (4, deep), (5, json.dumps({"root": {**node, "children": [{**node, "depth": 1}, 7, {"id": 3}]}})), (6, json.dumps({"root": node}))]
    d = spark.createDataFrame(trees_, "doc_id long, tree string")
    got = {}
    for r in trees.validate_trees(d).collect():
        got.setdefault(r["doc_id"], []).append((r["ord"], r["error"]))
    whole = [(None, "expected exactly a root")]
    assert got[2] == got[3] == got[4] == whole and 6 not in got
    assert sorted(got[1]) == [(2, "wrong depth"), (3, "label must be a string")]
    assert (1, "empty, invalid or repeated id") in got[5] and (2, "node must be an object") in got[5] and {e for n, e in got[5] if n == 3} >= {"unexpected or missing fields", "id must be a string", "wrong depth", "children must be an array"}
    assert {r["doc_id"] for r in trees.flatten_trees(d).collect()} == {1, 5, 6}
    chain = spark.range(1, 3000).selectExpr("7L doc_id", "cast(id as string) node_id", "cast(if(id = 1, null, id - 1) as string) parent_id", "0L sibling_pos", "'' label", "'' title", "'' text", "id - 1 depth")
    assert trees.nest_trees(chain).first()["tree"].count('"children"') == 2999


def test_chains(spark):
    up = {"a": None, "b": "a", "c": "b", "d": "e", "e": "d", "f": "d", "g": "gone", "h": "h"} | {f"n{k}": f"n{k - 1}" if k else "c" for k in range(70)}
    n = spark.createDataFrame([(1, x, p) for x, p in up.items()], "doc_id long, node_id string, parent_id string")
    got = {r["node_id"]: r["node_path"] for r in trees.chains(n).collect()}
    want = {"a": ["a"]}
    for x in ("b", "c", *(f"n{k}" for k in range(70))):
        want[x] = [*want[up[x]], x]
    assert got == want


def test_moves(spark):
    n = trees.recompute_depths(trees.normalize_nodes(flat(spark)))
    for move, want in (
        (("a", "c", "after"), {"c": ("root", 0), "a": ("root", 1)}), (("c", "a", "before"), {"c": ("root", 0), "a": ("root", 1)}), (("c", "b", "inside"), {"c": ("b", 0), "a": ("root", 0)}),
        (("a", "b", "inside"), {"a": ("root", 0), "c": ("root", 1)}), (("root", "a", "inside"), {"a": ("root", 0), "c": ("root", 1)}), (("c", "nowhere", "inside"), {"a": ("root", 0), "c": ("root", 1)}), (("b", "root", "before"), {"b": ("root", 0), "a": ("root", 1)}),
    ):
        got = trees.reparent_subtrees(n, spark.createDataFrame([(1, *move)], "doc_id long, node_id string, target_id string, position string")).collect()
        assert {r["node_id"]: (r["parent_id"], r["sibling_pos"]) for r in got if r["node_id"] in want} == want


def test_alignment_in_order(spark):
    """The closed form of claims against the plain loop over references, on random tables."""
    import random

    from outline_jobs.operators import evaluation

    r = random.Random(8)
    refs, preds, cands, links, want = [], [], [], [], {}
    for doc in range(40):
        titles = ["A", "B", "C", "D"]
        own = [(f"p{k}", r.choice(titles)) for k in range(r.randrange(1, 6))]
        wanted = [(f"r{k}", r.choice(titles), f"p{r.randrange(6)}" if r.random() < 0.5 else None) for k in range(r.randrange(1, 6))]
        preds += [(doc, "root", None, "", "", "")] + [(doc, p, "root", "", t, "") for p, t in own]
        cands += [(doc, p, 1, p, "", t, 0) for p, t in own]
        refs += [(doc, "root", None, -1, "", "", "")] + [(doc, x, "root", k, "", t, "") for k, (x, t, _) in enumerate(wanted)]
        links += [(doc, x, [1], p, True) for x, _, p in wanted if p]
        used, names = set(), dict(own)
        for x, t, p in wanted:
            if p in names:
                found, sure = (p if p not in used else None), True
            else:
                free = [q for q, s in own if s == t and q not in used]
                found, sure = (free[0] if len(free) == 1 and [s for _, s, _ in wanted].count(t) == 1 else None), False
            if found:
                used.add(found)
            want[doc, x] = (found, "confirmed" if sure and found else "needs_manual_alignment")
    node = "doc_id long, node_id string, parent_id string"
    alignment = spark.createDataFrame(links, "doc_id long, reference_id string, pages array<int>, heading_text string, confirmed boolean").selectExpr("*", "cast(null as string) canonical_revision", "cast(null as int) start")
    got = evaluation.align_headings(
        spark.createDataFrame(refs, node + ", ord int, label string, title string, text string"), spark.createDataFrame(preds, node + ", label string, title string, text string"),
        spark.createDataFrame(cands, "doc_id long, candidate_id string, page int, raw string, label string, title string, start int"), alignment, spark.createDataFrame([(d, "v") for d in range(40)], "doc_id long, revision string"))
    assert {(x["doc_id"], x["reference_id"]): (x["prediction_id"], x["status"]) for x in got.collect()} == want
