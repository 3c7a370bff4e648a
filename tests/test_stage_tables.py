"""What the stage tables of the evidence outline leave on disk, and the shapes of plans that keep large corpora within it."""

import glob

import pytest
from pyspark.sql import functions as F

from outline_jobs.functions import tables
from outline_jobs.operators import decisions, quality, trees
from outline_jobs.plans import corpus
from outline_jobs.plans.evidence_outline import EvidenceOutline

PAGE = "doc_id long, document_hash string, page int, markdown string, plain_text string, table_count int, blocks array<array<double>>, extraction_status string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def folder(spark):
    return tables.stage_path(spark, "x").rpartition("/")[0].removeprefix("file:")


@pytest.fixture()
def docs(spark, tmp_path):
    def make(rows):
        spark.createDataFrame(rows, "doc_id long, text string, source string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return make


def test_pages_are_made_without_an_exchange(spark, docs):
    """The corpus alone moved every line of every text through a shuffle."""
    text = "\n".join(f"line {k} of a text" for k in range(15))
    sf = docs([(1, text, "a"), (2, None, None), (6, "one", "b"), (13, text, "c")])
    pages = corpus.corpus(spark, sf)["pages"]
    assert "Exchange" not in plan(pages)
    got = {(r["doc_id"], r["page"]): r["markdown"] for r in pages.collect()}
    assert len(got) == 8 and got[2, 1].split("\n\n") == ["CORPUS ", "# 1. Item", "Text  end.", "1"]
    assert got[1, 2].split("\n\n")[:4] == ["CORPUS a", "# 2. line 6 of a text", "line 6 of a text", "line 7 of a text"]


def test_repeated_ids_still_share_pages(spark, docs):
    one = [(r["page"], r["markdown"]) for r in corpus.corpus(spark, docs([(4, "x\ny", "a")]))["pages"].collect()]
    both = [(r["page"], r["markdown"]) for r in corpus.corpus(spark, docs([(4, "x\ny", "a"), (4, "x\ny", "a")]))["pages"].collect()]
    assert [p for p, _ in one] == [p for p, _ in both] == [1]
    assert both[0][1].split("\n\n") == [b for b in one[0][1].split("\n\n") for _ in range(2)]


def test_texts_are_stored_once_and_rounds_are_dropped(spark):
    """The texts of segments and nodes lie in the pages alone; of the rounds of `chains` the last one is left."""
    rows = [(1, "h", p, f"# {p}. T\n\nwords here\n\n## {p}.1 U\n\nmore", "words", 0, [], "extracted") for p in (1, 2, 3)]
    o = EvidenceOutline(spark.createDataFrame(rows, PAGE))
    assert "text" not in o.cuts.columns and "plain_text" not in o.pages.columns and {"start", "separator_before"} <= set(o.cuts.columns)
    assert {r["text"] for r in o.segments.collect()} >= {"# 1. T"}
    n = spark.createDataFrame([(1, str(k), str(k - 1) if k else None) for k in range(9)], "doc_id long, node_id string, parent_id string")
    before = set(glob.glob(f"{folder(spark)}/tree-chains-*/*.parquet"))
    assert trees.chains(n).count() == 9
    assert len({x.rpartition("/")[0] for x in set(glob.glob(f"{folder(spark)}/tree-chains-*/*.parquet")) - before}) == 1


def test_shuffle_files_go_with_their_stage(spark):
    blocks = lambda: int(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().size())
    before = blocks()
    tables.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "few")
    assert blocks() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_folds_take_many_documents_at_once(spark):
    """A pandas frame for each document took most of the time."""
    rows = [(d, "h", 1, f"# 1. T{d}\n\nText", "x", 0, [], "extracted") for d in range(600)]
    o = EvidenceOutline(spark.createDataFrame(rows, PAGE))
    assert "FlatMapGroupsInPandas" not in plan(decisions.decide(o.evidence)) and "MapInArrow" in plan(decisions.decide(o.evidence))
    assert o.decided.select("doc_id").distinct().count() == 600
    assert o.regions.count() == o.replies.count()


@pytest.mark.parametrize("a, b", [("x y\nx y\nz", "x y\nz z"), ("p q\nr", "# p q\nr"), (None, "a"), ("a\n\nb", "b\n\n\nc a"), ("", "")])
def test_unlike_lines_change_no_difference(spark, a, b):
    d = spark.createDataFrame([(1, a, b)], "k int, a string, b string")
    x, y = quality.unlike_lines(F.col("a"), F.col("b"))
    rows = lambda t: sorted(map(tuple, quality.token_diff(t, ["k"], "a", "b").collect()))
    assert rows(d) == rows(d.select("k", x.alias("a"), y.alias("b")))


def test_spans_without_a_signal_are_not_joined(spark):
    """Margins were joined with every span, and the spans were cut twice."""
    from outline_jobs.operators import blocks

    d = spark.createDataFrame([(1, 1, "# A\n\n" + "word " * 60 + "end.\n\nShort")], "doc_id long, page int, markdown string")
    spans = tables.kept_together(blocks.block_spans(d), "spans")
    assert [r["raw"] for r in blocks.block_signals(spans).orderBy("start").collect()] == ["# A", "Short"]
    p = plan(blocks.block_signals(spans))
    assert "_first" in p[p.index("SortMergeJoin" if "SortMergeJoin" in p else "BroadcastHashJoin") :]


def test_small_files_are_read_in_few_tasks(spark, tmp_path):
    """A task for every few files, and a listing task for each folder."""
    from outline_jobs.sources import pages as src

    for k in range(40):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "alignment.json").write_text("[1]" if k % 2 else '{"r": {"pages": [1]}}')
    bad = src.alignment_errors(spark, str(tmp_path))
    assert bad.count() == 20 and src.read_alignment(spark, str(tmp_path)).count() == 20
    assert bad.rdd.getNumPartitions() <= 4
