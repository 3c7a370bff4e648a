"""The line outline on tiny inputs with known answers, and its closed forms against plain loops."""

import random

from pyspark.sql import functions as F

from outline_jobs.functions import text as tx
from outline_jobs.operators import lines as op
from outline_jobs.plans.line_outline import LineOutline

PAGE = "doc_id long, page int, markdown string, plain_text string"


def outline(spark, *pages):
    rows = [(1, i + 1, p, p + " " * 0 + "x" * 60) for i, p in enumerate(pages)]
    return LineOutline(spark.createDataFrame(rows, PAGE), spark.createDataFrame([], "doc_id long, page int, text string"))


def test_labels(spark):
    cases = {
        "1.2 Scope": ("1.2", "Scope", 2), "1.2.3. Deep": ("1.2.3", "Deep", 3), "3. Rules": ("3", "Rules", 1), "Section 4.1 More": ("4.1", "More", 2), "Article IV Rights": ("IV", "Rights", 1),
        "(a) first": ("(a)", "first", None), "(12) item": ("(12)", "item", None), "B. Second": ("B", "Second", None), "1 Bare": ("", "1 Bare", None), "plain": ("", "plain", None),
    }
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.line_label(F.col("t")).alias("l"))
    assert {r["t"]: tuple(r["l"]) for r in d.collect()} == cases


def test_roman_and_readings(spark):
    d = spark.createDataFrame([("IV",), ("xix",), ("IIII",), ("",), ("MCMXC",)], "t string").select("t", tx.roman_value(F.col("t")).alias("v"))
    assert {r["t"]: r["v"] for r in d.collect()} == {"IV": 4, "xix": 19, "IIII": None, "": None, "MCMXC": 1990}
    d = spark.createDataFrame([("(i)",), ("2.3.",), ("A.",), ("",)], "t string").select("t", tx.label_readings(F.col("t")).alias("r"))
    found = {r["t"]: [(x["family"], x["value"], x["series"]) for x in r["r"]] for r in d.collect()}
    assert found == {"(i)": [("alpha", 9, "alpha:lower:parenthesized"), ("roman", 1, "roman:lower:parenthesized")], "2.3.": [("numeric", 3, "numeric:.:[2]")], "A.": [("alpha", 1, "alpha:upper:.")], "": []}


def test_tree_and_flags(spark):
    o = outline(spark, "# Handbook\nIntro\n# 1. Scope\nBody one\n## 1.1 Part\nText", "## 1.3 Gap\n# 1. Scope\n(a) Sub\nEnd")
    nodes = {r["ord"]: (r["label"], r["title"], r["depth"], r["text"]) for r in o.nodes.collect()}
    assert nodes == {0: ("", "Handbook", 0, "Intro"), 1: ("1", "Scope", 1, "Body one"), 2: ("1.1", "Part", 2, "Text"), 3: ("1.3", "Gap", 2, ""), 4: ("1", "Scope", 1, ""), 5: ("(a)", "Sub", 2, "End")}
    rules = sorted((r["rule"], r["detail"]) for r in o.flags.collect())
    assert ("numbering_gap", "1 to 3") in rules and ("duplicate_label", "1 occurs 2 times") in rules and ("orphan_body", "5 characters before the first heading") in rules


def test_noise(spark):
    page = lambda k: f"ACME Manual {k}\nContents\nOne .... 1\nTwo .... 2\nThree .... 3\nReal text {'abc'[k]}\n{k + 1}"
    noise = {(r["page"], r["text"]): r["noise"] for r in outline(spark, page(0), page(1), page(2)).noise.collect()}
    assert noise[1, "ACME Manual 0"] == "header" and noise[1, "1"] == "pageno" and noise[2, "Real text b"] is None


def test_toc_title(spark):
    o = outline(spark, "Contents\nOne .... 1\nTwo .... 2\nThree .... 3\nBody")
    assert [r["noise"] for r in o.noise.orderBy("line_idx").collect()] == ["toc"] * 4 + [None]


def test_clamp_and_parents_match_loops(spark):
    r = random.Random(4)
    levels = {d: [r.randint(1, 6) for _ in range(r.randint(1, 25))] for d in range(30)}
    rows = [(d, i, "t", "", lev, "md") for d, ls in levels.items() for i, lev in enumerate(ls)]
    c = op.clamp_level_jumps(spark.createDataFrame(rows, "doc_id long, line_idx int, text string, label string, level int, source string"))
    got = {(x["doc_id"], x["line_idx"]): (x["level"], x["parent_line"]) for x in op.line_parents(c).collect()}
    for d, ls in levels.items():
        last, stack = 0, []
        for i, lev in enumerate(ls):
            last = min(lev, last + 1)
            while stack and stack[-1][0] >= last:
                stack.pop()
            assert got[d, i] == (last, stack[-1][1] if stack else None)
            stack.append((last, i))


def test_labels_of_visible_text(spark):
    from outline_jobs.plans import evaluation_queries

    texts = ["# 1. Scope", "## 1.1 Part <sup>2</sup>", "**(a) Bold**", "plain words", "## 10.10.10.1 Deep", "1." + "9" * 30 + " Long", "iv. Roman", "# Title"]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_idx int, text string").selectExpr("1 as doc_id", "*")
    labels = evaluation_queries.labelled(lines)
    assert {r["line_idx"]: (r["label"], r["title"]) for r in labels.collect()} == {
        0: ("1.", "Scope"), 1: ("1.1", "Part"), 2: ("(a)", "Bold"), 3: ("", "plain words"), 4: ("10.10.10.1", "Deep"), 5: ("1." + "9" * 30, "Long"), 6: ("iv.", "Roman"), 7: ("", "Title")}
    found = sorted((r["line_idx"], r["family"], int(r["value"]), r["series"]) for r in evaluation_queries.readings(labels).collect())
    assert found == [(0, "numeric", 1, "numeric:.:[]"), (1, "numeric", 1, "numeric:bare:[1]"), (2, "alpha", 1, "alpha:lower:parenthesized"), (4, "numeric", 1, "numeric:bare:[10, 10, 10]"), (5, "numeric", int("9" * 30), "numeric:bare:[1]"), (6, "roman", 4, "roman:lower:.")]


def test_stats_of_real_ids_and_depths(spark):
    from outline_jobs.operators import trees
    from outline_jobs.plans import tree_queries

    nodes = outline(spark, "# Handbook\nIntro\n# 1. Scope\nBody one\n# 2. Next\nText", "# 1. Scope\nEnd").nodes
    ids = [r["node_id"] for r in nodes.collect()]
    s = trees.tree_stats(tree_queries.with_true_depth(nodes)).first()
    assert len(ids) - len(set(ids)) == s["duplicate_ids"] == 1 and s["depth_issues"] == 0 and s["total_nodes"] == len(ids)
    wrong = nodes.withColumn("depth", F.when(F.col("label") == "2", 4).otherwise(F.col("depth")))
    assert trees.tree_stats(tree_queries.with_true_depth(wrong)).first()["depth_issues"] == 1


def test_stages_lie_by_document(spark):
    """After the pages are kept, no stage up to the headings exchanges rows by key, even where Spark may not broadcast a side."""
    from pyspark.sql import functions as F

    from outline_jobs.functions.tables import together
    from outline_jobs.operators import lines as op
    from outline_jobs.plans import corpus
    from outline_jobs.plans.line_outline import LineOutline

    c = corpus.corpus(spark, "/root/testdata/sf0.001")
    o = LineOutline(c["pages"], c["ocr"])
    counts = o.page_text.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"))
    plans = {
        "noise": op.mark_noise(o.lines, counts), "candidates": op.find_line_candidates(o.noise), "levels": op.clamp_level_jumps(op.resolve_line_levels(o.candidates)),
        "headings": op.line_node_ids(op.line_parents(op.pick_title(o.noise, o.levels)[2])), "owned": op.assign_lines(o.noise, o.headings),
    }
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with together(spark):
            found = {k: d._jdf.queryExecution().executedPlan().toString().count("Exchange") for k, d in plans.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert found == dict.fromkeys(plans, 0)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_")]
