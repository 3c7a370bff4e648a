"""Document fingerprints by consistent weighted sampling.

A document is a set of weighted terms: its words, weighted by how often each occurs (or word n-grams, by `n`).
For each of SAMPLES draws every term has its own r and c from a Gamma(2, 1) distribution and b from a
uniform one, all fixed by the term's hash; with t = floor(ln(w) / r + b) the draw takes the term with the least
ln(c) - r * (t - b + 1). Two documents agree on a draw (term and t) with a probability equal to their
generalised Jaccard similarity, sum of min(w) over sum of max(w). A fingerprint keeps 16 bits of each draw.

Defined cases. Null is the empty text. A text without words has the fingerprint of all zeros; two such agree fully, and with
any other text not at all. Equal texts have equal fingerprints. In with_edits(), rows with one doc_id are ordered by their text; those with a null
doc_id come first of all, in slice 0.
Empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outline_jobs.llm.common import mixed, shingle_hashes, table, word_hashes, written

#: Draws of a fingerprint; the error of a likeness is about half the root of one over it.
SAMPLES = 128
#: Terms handled at once, so that memory doesn't grow with a text.
BLOCK = 2048


@cache
def _draws() -> dict[str, np.ndarray]:
    """65,536 draws of (r, ln c, b), the value and t they give a term of weight 1, and salts: a term's hash picks its draw."""
    g = np.random.Generator(np.random.PCG64(7))
    r, c, b = g.gamma(2.0, 1.0, 65_536), np.log(g.gamma(2.0, 1.0, 65_536)), g.random(65_536)
    f = np.float32
    return {"r": r.astype(f), "inverse": (1 / r).astype(f), "base": (c + r * (b - 1)).astype(f), "b": b.astype(f), "salt": g.integers(1, 2**63, SAMPLES // 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)}


def signature(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """16 bits of each draw for distinct term hashes and their positive weights; zeros without terms."""
    out = np.zeros(SAMPLES, np.uint16)
    if not len(terms):
        return out
    d = _draws()
    order = np.argsort(weights == 1, kind="stable")  # those of other weights first
    terms, weights = terms[order], weights[order]
    least = np.full((4, SAMPLES // 4), np.inf, np.float32)
    code = np.zeros((4, SAMPLES // 4), np.uint64)
    for i in range(0, len(terms), BLOCK):
        h, w = terms[i : i + BLOCK], weights[i : i + BLOCK]
        n = int((w != 1).sum())
        log_w = np.log(w[:n]).astype(np.float32)
        x = d["salt"][:, None] * h
        x ^= x >> np.uint64(32)
        parts = x.view(np.uint16).reshape(len(d["salt"]), len(h), 4)
        for j in range(4):
            pick = parts[:, :, j].astype(np.intp)
            value = d["base"].take(pick, mode="wrap")
            if n:
                few = pick[:, :n]
                t = np.floor(log_w * d["inverse"].take(few, mode="wrap") + d["b"].take(few, mode="wrap"))
                value[:, :n] -= d["r"].take(few, mode="wrap") * t
            at = value.argmin(axis=1)
            row = np.arange(len(at))
            best = value[row, at]
            took = h[at] * np.uint64(31)
            if n:
                took += np.where(at < n, t[row, np.minimum(at, n - 1)].astype(np.int64), 0).view(np.uint64)
            less = best < least[j]
            least[j], code[j] = np.where(less, best, least[j]), np.where(less, took, code[j])
    return np.maximum(mixed(code.ravel()) >> np.uint64(48), np.uint64(1)).astype(np.uint16)


def fingerprint(text: str | None, n: int = 1) -> np.ndarray:
    words = word_hashes(text)
    terms, counts = np.unique(words if n == 1 else shingle_hashes(words, n), return_counts=True)
    return signature(terms, counts)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of draws on which two fingerprints agree."""
    return float((a == b).mean())


def hexed(a: np.ndarray) -> str:
    return a.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, n: int = 1) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fingerprint": [hexed(fingerprint(x, n)) for x in batch["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, per_slice: int = 2000) -> DataFrame:
    """Rows dealt into slices of neighbouring doc_ids, each slice with the first row of the one after it (after the last: of the first).

    Only ids are read to choose the slices; their first ids, one for each slice, are a table as small as the number
    of tasks. Texts move once. Columns: _slice, _guest (true for the row lent by the next slice), doc_id, text.
    """
    ids = docs.select("doc_id").where("doc_id is not null")
    low, high, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    n_slices = max(1, n // per_slice)
    cuts = sorted({*ids.stat.approxQuantile("doc_id", [k / n_slices for k in range(1, n_slices)], 0.2 / n_slices)}) if n_slices > 1 else []
    cuts = [c for c in cuts if c > (low or 0)]
    spark = docs.sparkSession
    # approxQuantile gives ids as doubles; they only choose borders, so their rounding is harmless.
    edges = np.array(cuts, dtype=float)

    @F.pandas_udf("int")
    def slice_of(i: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, i.to_numpy(dtype=float), side="right").astype("int32"))

    own_slice = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(slice_of(F.coalesce("doc_id", F.lit(0))))
    dealt = docs.select("doc_id", own_slice.alias("_slice"))
    # The head of a slice is null where rows without a doc_id begin it.
    heads = written(dealt.groupBy("_slice").agg(F.when(F.max(F.col("doc_id").isNull()), F.lit(None)).otherwise(F.min("doc_id")).alias("_head")), "slice-heads")
    order = [r["_slice"] for r in heads.select("_slice").orderBy("_slice").collect()]
    lends = spark.createDataFrame([(s, order[k - 1]) for k, s in enumerate(order)] or [(-1, -1)], "_slice int, _to int")
    heads = heads.join(F.broadcast(lends), "_slice")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_own", own_slice)
    h = F.broadcast(heads.select(F.col("_head"), F.col("_to")))
    rows = rows.join(h, rows["doc_id"].eqNullSafe(h["_head"]), "left")
    places = F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_own").alias("_slice"), F.lit(False).alias("_guest")))).otherwise(
        F.array(F.struct(F.col("_own").alias("_slice"), F.lit(False).alias("_guest")), F.struct(F.col("_to").alias("_slice"), F.lit(True).alias("_guest")))
    )
    out = rows.select(F.explode(places).alias("_p"), "doc_id", "text").select("_p._slice", "_p._guest", "doc_id", "text")
    return out.repartition("_slice").sortWithinPartitions("_slice", "_guest", "doc_id", "text")


def with_edits(docs: DataFrame, n: int = 1) -> DataFrame:
    """Every document with its fingerprint, that of its edited text, and how like they and the next document's are."""

    def row(one, nxt):
        (doc_id, text, sig), (_, other, after) = one, nxt
        half = len(text) // 2
        edited = (text[:-half] if half else text) + other[:half]
        sig_e = fingerprint(edited, n)
        return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), hexed(sig), hexed(sig_e), likeness(sig, sig_e), likeness(sig, after)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = here = None  # the row that waits for the one after it, and its slice
        done = False  # the slice's guest has been used
        for batch in batches:
            out = []
            for s, guest, doc_id, text in batch.itertuples(index=False):
                if s != here:
                    held, here, done = None, s, False
                if guest and done:
                    continue
                now = (doc_id, text, fingerprint(text, n))
                if held is not None:
                    out.append(row(held, now))
                held, done = (None if guest else now), guest
            yield pd.DataFrame(out, columns=names)

    # As text, since pandas would turn ids among nulls into doubles.
    dealt = with_next(docs).select("_slice", "_guest", F.col("doc_id").cast("string").alias("doc_id"), "text")
    return dealt.mapInPandas(run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumn("doc_id", F.col("doc_id").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))
