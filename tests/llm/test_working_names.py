"""Columns of the caller's that are called as what operators name on their way, in any case, come through with their values."""

import pytest

from outline_jobs.llm import decontamination, factorization, main_text, mixing, ngram_join, url_lists

WORKING = (
    "_u _tie _source _lean _from _p _rank _e _whole _place _ns _bs _s _need _last _cut _copy _copies _row _key _text Size Target Taken COPIES "
    "h1 h2 _id _none _head root rep first Score Hits _best _host _domain _at _own _salt Entry Since _k _t _h n"
).split() + ["a.b", "a b"]


@pytest.fixture(scope="module")
def named(spark):
    base = "The quick brown fox jumps over the lazy dog and runs on through the dark wood until the morning comes again"
    texts = [base, base, base + " twice", "another text of quite other words that nobody has seen before in this small table", None, ""]
    rows = [(i, t, "en", "ab"[i % 2], 9) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", *[f"concat('{c}-', doc_id) as `{c}`" for c in WORKING])


def whole(df, columns, key="doc_id"):
    """All rows in these columns, with the values the caller gave."""
    assert df.columns == columns
    rows = df.collect()
    for r in rows:
        for c in WORKING:
            assert r[columns.index(c)] == f"{c}-{r[key]}", c
    return rows


def test_mix_keeps_working_names(named):
    rows = whole(mixing.mixed_documents(named), named.columns)
    plain = mixing.mixed_documents(named.select("doc_id", "text", "lang", "source")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in plain) and rows
    assert {r["own_Size"] for r in mixing.mix(named).collect()} == {f"Size-{i}" for i in range(6)}


def test_one_of_each_keeps_working_names(named):
    rows = whole(ngram_join.one_of_each(named), named.columns)
    assert sorted(r["doc_id"] for r in rows) == [0, 3, 4]


def test_filters_keep_working_names(spark, named):
    machine = factorization.trained(named.where("false"), spark.createDataFrame([], "doc_id long, quality int"))
    assert len(whole(factorization.accepted(named, machine), named.columns)) == 6
    bench = spark.createDataFrame([(1, "another text of quite other words that nobody has seen before in this small table")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in whole(decontamination.clean(named, bench), named.columns)) == [0, 1, 2, 4, 5]


def test_lists_keep_working_names(spark, named):
    captures = named.selectExpr("doc_id as page_id", "'http://x.a.com/' as url", "timestamp'2024-02-01' as fetched_at", *[f"`{c}`" for c in WORKING])
    active = spark.sql("select 'x' list_name, 'a.com' host, timestamp'2024-01-01' since, cast(null as timestamp) until")
    out = url_lists.join_as_of(captures, active)
    names = [f"own_{c}" if c in ("Entry", "Since") else c for c in captures.columns]
    assert out.columns == [*names, *url_lists.RESULTS]
    rows = out.collect()
    assert len(rows) == 6 and all(r["blocked"] for r in rows)
    for r in rows:
        assert all(r[captures.columns.index(c)] == f"{c}-{r['page_id']}" for c in WORKING)


def test_extraction_keeps_an_own_text(spark):
    pages = spark.createDataFrame([(1, "<p>" + "Many words of an article stand here. " * 9 + "</p>", "mine")], "page_id long, html string, Text string")
    found = main_text.extracted(pages)
    assert found.columns == ["page_id", "html", "own_Text", "text"]
    assert found.first()["own_Text"] == "mine" and found.first()["text"] == main_text.extracted(pages.select("page_id", "html")).first()["text"]
