"""Benchmark items found in documents: SimHash windows of item size, multi-index Hamming blocks, exact verification.

A text is the sequence of its neighbouring word pairs. An item is represented by anchors, windows of its own size less the
edges: of the item's n-grams, a document window whose weighted similarity reaches the threshold lacks at most
k = floor(n * (1 - t) / (1 + t)), so an edit inside lies k words from an edge or costs a whole run of n-grams, and with
floor(k / gram) + 1 anchors side by side at least one is free of edits. Anchor lengths are rounded down to a ladder; of every rung,
documents are fingerprinted every STRIDE pairs and anchors at STRIDE offsets, so that an anchor free of edits is met wherever it lies.

Fingerprints of 64 bits are cut into RADIUS + 1 blocks: two within RADIUS bits agree in a block, so looking up every block
in an index finds all fingerprints within the radius. Each hit is verified by the exact weighted Jaccard similarity of
word n-grams (weight: number of occurrences) between the item and the document's windows of the item's length that start within AROUND words of the
anchor's own alignment, since words put in or left out before the anchor shift the best window.

The benchmark is dealt into parts of at most PART_BYTES of text, each broadcast and passed over the documents; one part in practice.
Documents are read where they are: no shuffle, and memory is bounded by CHUNK words.

Defined cases. Null is the empty text; texts and items without words match nothing. Items shorter than an n-gram are one n-gram of all their
words. Repeated items are each reported. Repeated documents each have their rows. Empty tables give empty results; extra columns are kept by clean().
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outline_jobs.llm.common import WORD_PATTERN, apart, mixed, shingle_hashes, table, word_hashes

#: Blocks are 16 bits wide.
RADIUS, BITS, WIDTH, STRIDE, CHUNK, PART_BYTES, AROUND = 3, 64, 16, 6, 8192, 8_000_000, 6
#: Window lengths in word pairs, from FIRST on each about three tenths above the last; shorter ones are met at every pair.
FIRST = 7
LADDER = [*range(1, FIRST), *(round(FIRST * 1.3**k) for k in range(40))]


def pairs_of(words: np.ndarray) -> np.ndarray:
    """A hash for every two words in a row; the word itself where there is but one."""
    return words if len(words) < 2 else mixed(words[:-1] * np.uint64(3) + words[1:])


def window_fingerprints(pairs: np.ndarray, length: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, SimHash) of the windows of `length` pairs at every multiple of `step`."""
    return next(iter(ladder_fingerprints(pairs, {length: step}).values()))


def ladder_fingerprints(pairs: np.ndarray, rungs: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The windows of several lengths, from one running count of set bits; at most CHUNK words of counts at a time."""
    found: dict[int, list] = {r: [] for r in rungs}
    longest = max(rungs)
    for a in range(0, max(len(pairs), 1), CHUNK):
        part = pairs[a : a + CHUNK + longest]
        count = np.zeros((len(part) + 1, BITS), np.int32 if len(part) > 32_000 else np.int16)
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), BITS)
        np.cumsum(bits, axis=0, out=count[1:], dtype=count.dtype)
        for r, step in rungs.items():
            first, stop = -a % step, min(CHUNK, len(part) - r + 1)
            if first < stop:
                ones = count[first + r : stop + r : step] - count[first:stop:step]
                found[r].append((np.arange(first, stop, step) + a, np.packbits(ones > r // 2, axis=1, bitorder="little").view(np.uint64)[:, 0]))
    empty = (np.empty(0, np.int64), np.empty(0, np.uint64))
    return {r: (np.concatenate([x[0] for x in f]), np.concatenate([x[1] for x in f])) if f else empty for r, f in found.items()}


def rung_for(length: int) -> tuple[int, int]:
    """(window length, stride) for an anchor of so many pairs: its windows at all offsets below the stride lie within it."""
    return max((r, STRIDE if r >= FIRST else 1) for r in LADDER if r + (STRIDE if r >= FIRST else 1) - 1 <= length)


class Index:
    """Items ready for search."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, gram: int):
        self.threshold, self.gram, self.rungs = threshold, gram, {}
        self.ids, self.words, self.grams = [], [], []
        marks: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # rung -> fingerprint, item, where the window starts in the item
        for ident, text in items:
            words = word_hashes(text)
            if not len(words):
                continue
            k = int((max(len(words) - gram, 0) + 1) * (1 - threshold) / (1 + threshold) + 1e-9)
            pairs = pairs_of(words)
            core = pairs[k : len(pairs) - k]
            for part in np.array_split(np.arange(k, k + len(core)), k // gram + 1):
                rung, step = rung_for(len(part))
                self.rungs[rung] = step
                starts, prints = window_fingerprints(pairs[part[0] : part[0] + rung + step - 1], rung, 1)
                marks[rung] += [(int(f), len(self.ids), int(part[0] + s)) for s, f in zip(starts, prints)]
            self.ids.append(ident)
            self.words.append(len(words))
            self.grams.append(np.unique(shingle_hashes(words, gram), return_counts=True))
        rows = [(f, rung, item, at) for rung, m in marks.items() for f, item, at in m]
        self.prints = np.array([x[0] for x in rows], np.uint64)
        self.rung_of, self.item_of, self.place_of = (np.array([x[k] for x in rows], np.int64) for k in (1, 2, 3))
        self.blocks = []
        for value in self.prints.view(np.uint16).reshape(-1, RADIUS + 1).T:
            order = np.argsort(value, kind="stable")
            border = np.searchsorted(value[order], np.arange((1 << WIDTH) + 1))
            self.blocks.append((order, border, np.diff(border) > 0))

    def near(self, prints: np.ndarray, rung: np.ndarray) -> Iterator[tuple[int, int]]:
        """All (window, mark) of one rung within RADIUS bits; some more than once."""
        for value, (order, border, used) in zip(prints.view(np.uint16).reshape(-1, RADIUS + 1).T, self.blocks):
            hit = np.flatnonzero(used[value])
            if len(hit):
                low = border[value[hit]]
                n = border[value[hit].astype(np.intp) + 1] - low
                w = np.repeat(hit, n)
                m = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
                good = (np.bitwise_count(prints[w] ^ self.prints[m]) <= RADIUS) & (rung[w] == self.rung_of[m])
                yield from zip(w[good].tolist(), m[good].tolist())

    def likeness(self, item: int, words: np.ndarray, at: int) -> float:
        """Weighted Jaccard similarity of the item's n-grams and those of the document's window at a word."""
        a, n = self.grams[item]
        b, m = np.unique(shingle_hashes(words[at : at + self.words[item]], self.gram), return_counts=True)
        place = np.minimum(np.searchsorted(a, b), len(a) - 1)
        both = np.minimum(n[place], m)[a[place] == b].sum()
        return float(both / (n.sum() + m.sum() - both))

    def search(self, text: str | None) -> list[tuple[int, float, int]]:
        """(item, similarity, word where the best window starts) for every item that reaches the threshold."""
        words = word_hashes(text)
        if not len(words) or not self.rungs:
            return []
        tried, best = set(), {}
        found = ladder_fingerprints(pairs_of(words), self.rungs)
        rung = np.repeat(list(found), [len(x) for x, _ in found.values()])
        starts, prints = (np.concatenate([x[k] for x in found.values()]) for k in (0, 1))
        for w, m in self.near(prints, rung):
            item = int(self.item_of[m])
            last = max(len(words) - self.words[item], 0)
            centre = int(starts[w] - self.place_of[m])
            for at in {min(max(centre + d, 0), last) for d in range(-AROUND, AROUND + 1)}:
                if (item, at) in tried:
                    continue
                tried.add((item, at))
                if (x := self.likeness(item, words, at)) >= self.threshold - 1e-9:
                    best[item] = max(best.get(item, (0.0, 0)), (x, -at))
        return [(self.ids[i], x, -at) for i, (x, at) in sorted(best.items())]


@lru_cache(maxsize=2)
def _index(items: tuple, threshold: float, gram: int) -> Index:
    return Index(list(items), threshold, gram)


def parts_of(benchmark: DataFrame) -> Iterator[tuple]:
    """The items in parts of a checked size."""
    b = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = b.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-size // PART_BYTES)
    for k in range(n):
        yield tuple(sorted((r["item_id"], r["text"]) for r in b.where(F.pmod(F.xxhash64("item_id", "text"), n) == k).collect()))


def _finder(shared, threshold: float, gram: int):
    @F.pandas_udf("array<struct<item_id: long, similarity: double, word_at: long>>")
    def find(text: pd.Series) -> pd.Series:
        index = _index(shared.value, threshold, gram)
        return pd.Series([[{"item_id": i, "similarity": x, "word_at": at} for i, x, at in index.search(t)] for t in text], dtype=object)

    return find


def with_hits(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, gram: int = 5) -> DataFrame:
    """docs with a column hits: an array of item_id, similarity, word_at; an own column of that name is called own_hits."""
    spark, hits = docs.sparkSession, []
    for items in parts_of(benchmark):
        shared = spark.sparkContext.broadcast(items)
        hits.append(_finder(shared, threshold, gram)(F.col("text")))
    none = F.array().cast("array<struct<item_id: bigint, similarity: double, word_at: bigint>>")
    return apart(docs, ("hits",))[0].withColumn("hits", F.concat(*hits) if hits else none)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, gram: int = 5) -> DataFrame:
    """doc_id, item_id, similarity and word_at of every item found in a document."""
    return with_hits(docs.select("doc_id", "text"), benchmark, threshold, gram).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, gram: int = 5) -> DataFrame:
    """docs without those that hold an item."""
    names = apart(docs, ("hits",))[1]
    return with_hits(docs, benchmark, threshold, gram).where(F.size("hits") == 0).select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD_PATTERN}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD_PATTERN}') AS w FROM benchmark),
ig AS (SELECT item_id, len(w) AS m, unnest(range(1, len(w) - 3)) AS p, array_to_string(w[p:p + 4], ' ') AS g FROM i WHERE len(w) >= 5),
dg AS (SELECT doc_id, len(w) AS nw, unnest(range(1, len(w) - 3)) AS p, array_to_string(w[p:p + 4], ' ') AS g FROM d WHERE len(w) >= 5),
spot AS (SELECT DISTINCT doc_id, item_id, m, least(greatest(dg.p - ig.p, 0), greatest(nw - m, 0)) AS q FROM dg JOIN ig USING (g)),
win AS (SELECT doc_id, item_id, q, g, count(*) AS n FROM spot JOIN dg USING (doc_id) WHERE dg.p > q AND dg.p <= q + m - 4 GROUP BY ALL),
own AS (SELECT item_id, g, count(*) AS n FROM ig GROUP BY ALL),
tot AS (SELECT item_id, sum(n) AS n FROM own GROUP BY ALL),
sim AS (SELECT win.doc_id, win.item_id, q, sum(least(win.n, coalesce(own.n, 0))) AS inter, sum(win.n) AS n FROM win LEFT JOIN own ON own.item_id = win.item_id AND own.g = win.g GROUP BY ALL)
SELECT doc_id, item_id, round(max(inter / (sim.n + tot.n - inter)), 6) AS similarity FROM sim JOIN tot USING (item_id) GROUP BY doc_id, item_id HAVING max(inter / (sim.n + tot.n - inter)) >= 0.8
"""
