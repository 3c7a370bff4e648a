"""What the driver holds while the pipeline runs, which has a limit of its own."""

import random
import tracemalloc

from outline_jobs.llm import factorization
from outline_jobs.llm.graph import components


def test_sample_reaches_the_fit_without_an_object_for_each_number(spark, monkeypatch):
    r = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randrange(50_000)}" for _ in range(400)), 2400) for i in range(1500)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1500)], "doc_id long, quality int")
    seen = {}

    def fit(rows, marks):
        seen.update(peak=tracemalloc.get_traced_memory()[1], bytes=sum(p.nbytes + v.nbytes for p, v in rows), rows=len(rows), marks=len(marks))
        return rows

    monkeypatch.setattr(factorization, "fit", fit)
    docs.limit(1).toPandas()  # what is imported at the first call doesn't count
    tracemalloc.start()
    try:
        rows = factorization.trained(docs, labels)
    finally:
        tracemalloc.stop()
    assert 1000 < seen["rows"] == seen["marks"] < 1400 and seen["peak"] < 2 * seen["bytes"]
    want = [(p.tolist(), v.tolist()) for i, t, n in sorted(map(tuple, docs.join(labels, "doc_id").where(~factorization.held_out(docs["doc_id"])).select("doc_id", "text", "n_chars").collect())) for p, v in [factorization.features(t, n)]]
    assert [(p.tolist(), v.tolist()) for p, v in rows] == want


def test_plans_of_components_hold_one_star(spark):
    r = random.Random(9)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(150)], "a long, b long")
    store = spark._jsparkSession.sharedState().statusStore()
    before = {x.executionId() for x in _listed(store)}
    got = {x["node"]: x["root"] for x in components(edges).collect()}
    assert all(got[k] == 0 for k in range(1, 61))
    sizes = [store.planGraph(x.executionId()).allNodes().size() for x in _listed(store) if x.executionId() not in before]
    assert len(sizes) > 5 and max(sizes) < 120


def _listed(store):
    every = store.executionsList()
    return [every.apply(k) for k in range(every.size())]
