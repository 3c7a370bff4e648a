"""Documents whose word n-grams overlap: MinHash banding finds candidates, full n-gram sets decide.

Equal texts are one class, so copies never meet each other. Each distinct text gets a MinHash signature cut into bands, whose
number and rows follow from the recall wanted at the threshold. Texts that share a band hash are hung below the smallest of them,
so a bucket of any size gives no more edges than members; the connected components of these edges hold every
candidate pair. A component is dealt into blocks of BLOCK texts, and each pair of blocks is one group: it compares its texts
by their full sets of n-grams as products of 0/1 matrices, and returns a count of links for each text and a spanning
forest of the links, not the pairs. No pair of texts is skipped, capped or compared twice.

Defined cases. Null is the empty text. Texts without words link to nothing; equal ones still form a class. Texts of fewer than n words are one
n-gram. Texts are told apart by their hashes, not by doc_id: rows that share a doc_id, or have none, but differ in text stay apart. A class is named by
its smallest doc_id, null if it has none. Repeated rows fall into one class. Empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outline_jobs.llm.common import WORD_PATTERN, looked_up, mixed, packed, shingle_hashes, table, unpacked, word_hashes, written
from outline_jobs.llm.graph import components

BLOCK = 256
COLUMNS = 8192


def bands_for(threshold: float, recall: float = 0.9999, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective rows with which bands of at most `hashes` values in all reach the recall at the threshold."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = max(1, math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of the MinHash signature of a set of n-gram hashes."""
    factors = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.uint64(2**64 - 1))
    for i in range(0, len(grams), 2048):
        np.minimum(least, (factors[:, None] * grams[i : i + 2048]).min(axis=1), out=least)
    out = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        out = mixed(out + least.reshape(bands, rows)[:, k])
    return out


def streamed_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of rows equal in keys from sorted batches, also where a group runs over several batches."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            this = tuple(k[a])
            if held and this != last:
                yield last, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            last = this
            held.append(batch.iloc[a:b])
    if held:
        yield last, pd.concat(held) if len(held) > 1 else held[0]


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of left with every set of right; sets are sorted and without repeats."""
    size = np.array([len(x) for x in (*left, *right)])
    every = np.concatenate((*left, *right)) if size.sum() else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate(([True], every[1:] != every[:-1])) if len(every) else np.empty(0, bool)
    gram = np.cumsum(new) - 1
    shared = np.bincount(gram, minlength=1)[gram] > 1
    owner, gram = owner[shared], gram[shared]
    gram = np.unique(gram, return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.float32)
    start = 0
    while start < len(gram):
        stop = int(np.searchsorted(gram, gram[start] + COLUMNS))
        m = np.zeros((len(size), gram[stop - 1] - gram[start] + 1), np.float32)
        m[owner[start:stop], gram[start:stop] - gram[start]] = 1
        out += m[: len(left)] @ m[len(left) :].T
        start = stop
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix, as edges to the smallest place of each tree."""
    left, edges = np.ones(len(linked), bool), []
    for i in range(len(linked)):
        if not left[i]:
            continue
        left[i] = False
        front = [i]
        while front:
            found = np.flatnonzero(linked[front].any(axis=0) & left)
            left[found] = False
            edges += [(int(x), i) for x in found]
            front = list(found)
    return edges


def text_keys() -> list[Column]:
    """Two hashes of a row's text, and its doc_id as two columns that are never null: together they tell rows apart."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("_id"), F.col("doc_id").isNull().alias("_none")]


KEYS = ["h1", "h2", "_id", "_none"]


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, hashes of its text (h1, h2) and its bands; no bands for texts without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            grams = [shingle_hashes(word_hashes(x), n) for x in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "h1": b["h1"], "h2": b["h2"], "bands": [band_hashes(g, bands, rows).view(np.int64) if len(g) else [] for g in grams]})

    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = t.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    return t.mapInPandas(run, "doc_id long, h1 long, h2 long, bands array<long>")


def compared(docs: DataFrame, members: DataFrame, threshold: float, n: int, pairs: bool = False) -> DataFrame:
    """members: root, rep and the keys of a row that holds the text. Counts of links (rep, n_links) with forest edges (rep, other), or all pairs (rep, other, similarity)."""
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("_n"))
    m = looked_up(members, sizes, ["root"], members.count()).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["root", "rep", "blocks", "block"]].assign(grams=[np.unique(shingle_hashes(word_hashes(x), n)).tobytes() for x in b["text"]])

    # A merge join at every size: the plan, and so its growth, doesn't change where one side happens to be small.
    found = docs.select(*text_keys(), "text").join(m.hint("merge"), KEYS).select("root", "rep", "blocks", "block", "text")
    found = found.mapInPandas(sets, "root long, rep long, blocks int, block int, grams binary")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = found.select("root", "rep", "block", "grams", F.explode(every).alias("other")).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "grams")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for (_, i, j), g in streamed_groups(batches, ["root", "i", "j"]):
            g = g.drop_duplicates("rep")
            rep = g["rep"].to_numpy()
            grams = [np.frombuffer(x, np.uint64) for x in g["grams"]]
            a = np.flatnonzero(g["block"].to_numpy() == i)
            b = a if i == j else np.flatnonzero(g["block"].to_numpy() == j)
            size = np.array([len(x) for x in grams])
            both = overlaps([grams[x] for x in a], [grams[x] for x in b])
            ratio = both / np.maximum(size[a][:, None] + size[b][None, :] - both, 1)
            hit = ratio >= threshold - 1e-6
            if i == j:
                np.fill_diagonal(hit, False)
            if pairs:
                x, y = np.nonzero(np.triu(hit) if i == j else hit)
                held.append(pd.DataFrame({"rep": rep[a[x]], "other": rep[b[y]], "n_links": 1, "similarity": ratio[x, y].astype(float)}))
            else:
                full = np.zeros((len(rep), len(rep)), bool)
                full[np.ix_(a, b)] = hit
                full |= full.T
                count = full.sum(axis=1)
                edges = forest(full)
                to = {x: rep[y] for x, y in edges}
                some = np.flatnonzero(count)
                held.append(pd.DataFrame({"rep": rep[some], "other": [to.get(x, rep[x]) for x in some], "n_links": count[some], "similarity": 0.0}))
            if sum(map(len, held)) > 5000:
                yield pd.concat(held)
                held = []
        if held:
            yield pd.concat(held)

    return dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "rep").mapInPandas(verify, "rep long, other long, n_links long, similarity double")


def candidates(docs: DataFrame, threshold: float, n: int, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, h1, h2; texts: rep, a number for each distinct text, its smallest doc_id as first, copies: how many rows hold it, and the keys of a row that holds it; members: root, rep and those keys, of candidate components)."""
    bands, rows = bands_for(threshold, recall)
    sig = written(signed(docs, n, bands, rows), "ngram-signatures")
    first = sig.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # Written, so that every reader sees the same numbers.
    texts = written(first.select(F.monotonically_increasing_id().alias("rep"), "first", "copies", "h1", "h2", F.coalesce("first", F.lit(0)).cast("long").alias("_id"), F.col("first").isNull().alias("_none")), "ngram-texts")
    reps = sig.select("h1", "h2", F.coalesce("doc_id", F.lit(0)).cast("long").alias("_id"), F.col("doc_id").isNull().alias("_none"), "bands").join(texts.select("rep", *KEYS), KEYS)
    band = written(reps.select("rep", F.explode("bands").alias("key")), "ngram-bands")
    hubs = band.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("end"), F.count(F.lit(1)).alias("_n")).where("hub <> end").drop("end")
    edges = looked_up(band, hubs, ["key"], band.count()).where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    tree = components(edges)
    members = tree.select("root", F.col("node").alias("rep")).unionByName(tree.select("root", F.col("root").alias("rep")).distinct())
    return sig.select("doc_id", "h1", "h2"), texts, written(members.join(texts.select("rep", *KEYS), "rep"), "ngram-members")


def similar_pairs(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999) -> DataFrame:
    """All linked pairs of texts by their smallest doc_ids: rep, other, similarity. Their number can be the square of a group's size."""
    _, texts, members = candidates(docs, threshold, n, recall)
    found = compared(docs, members, threshold, n, pairs=True)
    for side in ("rep", "other"):
        found = found.join(texts.select(F.col("rep").alias(side), F.col("first").alias(f"_{side}")), side)
    both = F.col("_rep").isNotNull() & F.col("_other").isNotNull()
    return found.select(F.least("_rep", "_other").alias("rep"), F.when(both, F.greatest("_rep", "_other")).alias("other"), "similarity")


def classified(docs: DataFrame, threshold: float, n: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """(rows as of candidates(); texts with their class's number as root and n_links)."""
    rows, texts, members = candidates(docs, threshold, n, recall)
    links = written(compared(docs, members, threshold, n), "ngram-links")
    counts = links.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    tree = components(links.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    facts = counts.join(tree.withColumnRenamed("node", "rep"), "rep", "left")
    return rows, texts.join(facts, "rep", "left").withColumns({"root": F.coalesce("root", "rep"), "n_links": F.coalesce("n_links", F.lit(0)).cast("long")})


def near_copies(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999) -> DataFrame:
    """doc_id; class_id: the smallest doc_id that copies and links lead to; copy_of: the smallest with an equal text; n_links: other texts linked to this one."""
    rows, texts = classified(docs, threshold, n, recall)
    texts = written(texts, "ngram-classes")
    heads = texts.groupBy("root").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("_n"))
    facts = looked_up(texts.select("root", "h1", "h2", "first", "n_links", "copies"), heads, ["root"], texts.count())
    out = looked_up(rows, facts.select("h1", "h2", "first", "class_id", "n_links", F.col("copies").alias("_n")), ["h1", "h2"], rows.count())
    return out.select("doc_id", "class_id", F.col("first").alias("copy_of"), "n_links")


def one_of_each(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999) -> DataFrame:
    """One row of docs for each class: of the text with the smallest doc_id (null last, then by hash), and of rows equal in doc_id and text the first by all columns."""
    _, texts = classified(docs.select("doc_id", "text"), threshold, n, recall)
    heads = texts.groupBy("root").agg(F.min(F.struct("_none", "_id", "h1", "h2")).alias("_head")).select("_head.*")
    kept = docs.select(packed(docs), "doc_id", "text").select("_row", *text_keys()).join(heads.hint("merge"), KEYS, "left_semi")
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("_row"))
    return kept.withColumn("_place", place).where("_place = 1").select(*unpacked(docs.columns, docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '{WORD_PATTERN}') AS w FROM documents),
c AS (SELECT doc_id, text, w, min(doc_id) OVER (PARTITION BY text) AS rep FROM w),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS gram FROM c WHERE doc_id = rep AND len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE n_both >= 0.8 * (x.n + y.n - n_both)),
r AS (SELECT doc_id AS a, doc_id AS b FROM c WHERE doc_id = rep UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS root FROM r GROUP BY a)
SELECT c.doc_id, m.root AS class_id, c.rep AS copy_of, (SELECT count(*) FROM l WHERE l.a = c.rep) AS n_links FROM c JOIN m ON m.a = c.rep
"""
