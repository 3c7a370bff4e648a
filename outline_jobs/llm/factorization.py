"""A factorisation machine for the quality of documents.

Inputs are hashed words (term frequencies of unit length), structure statistics of the text in steps, and as metadata
the recorded length n_chars; every pair of inputs interacts by the product of two low-rank vectors. A score takes time linear in
the words: sum over pairs of <v_i, v_j> x_i x_j = 1/2 sum over factors of ((sum v x)^2 - sum (v x)^2).

The model is fitted on a bounded sample of labelled rows, about SAMPLE of them, chosen by a hash of doc_id; everything else, scoring
first of all, covers every row. Labels, lang, source and doc_id are no inputs.

Defined cases. Null is the empty text and has a score like any other; a null n_chars is a step of its own. Of several labels of one document
the smallest counts; rows with a null label don't. Without labelled rows all scores are 0.5. Repeated rows have equal scores. Empty
tables give empty results; extra columns are kept by scored().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outline_jobs.llm.common import WORD_BYTE, apart, released, table, word_hashes

SAMPLE, RANK, WORD_BITS, STEPS = 8000, 8, 16, 12
UPDATES, BATCH, RATE, DECAY, SEED = 450, 128, 0.15, 1e-6, 5
STATS = ("length", "words", "word_length", "upper", "symbols", "digits", "distinct", "repeats", "period", "lines", "line_length", "line_repeats", "marks", "recorded")
SIZE = (1 << WORD_BITS) + len(STATS) * STEPS


def _step(x: float) -> int:
    """A share of 0 to 1 in steps that are finer near 0."""
    return int(min(STEPS - 1, np.sqrt(max(x, 0.0)) * STEPS))


def _log_step(x: float) -> int:
    return int(min(STEPS - 1, np.log2(1 + max(x, 0.0)) * 0.75))


def statistics(text: str, words: np.ndarray, recorded: int | None) -> list[int]:
    """The step of each of STATS."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n, w = max(len(raw), 1), max(len(words), 1)
    count = np.bincount(raw, minlength=256)
    letters = count[65:91].sum() + count[97:123].sum()
    lines = text.split("\n")
    stops = count[[46, 44, 33, 63]]
    back = [float((words[k:] == words[:-k]).mean()) if len(words) > k else 0.0 for k in (2, 3, 4, 25)]
    return [
        _log_step(len(text) / 16), _log_step(len(words) / 4), _log_step(4 * n / w), _step(count[65:91].sum() / max(letters, 1)),
        _step((count[33:127].sum() - letters - count[48:58].sum()) / n), _step(count[48:58].sum() / n),
        _step(len(np.unique(words)) / w), _step(float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0), _step(max(back)),
        _log_step(len(lines)), _log_step(n / len(lines) / 16), _step(1 - len(set(lines)) / len(lines)), _step((count[~WORD_BYTE].sum() - count[[10, 32]].sum() - stops.sum()) / n),
        STEPS - 1 if recorded is None or recorded != recorded else min(STEPS - 2, _log_step(recorded / 16)),
    ]


def features(text: str | None, recorded: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a document's inputs."""
    words = word_hashes(text)
    place, count = np.unique((words >> np.uint64(64 - WORD_BITS)).astype(np.int32), return_counts=True)
    value = count / max(np.sqrt((count.astype(float) ** 2).sum()), 1e-9)
    stat = [(1 << WORD_BITS) + k * STEPS + s for k, s in enumerate(statistics(text or "", words, recorded))]
    return np.concatenate((place, np.array(stat, np.int32))), np.concatenate((value, np.full(len(stat), 2 * len(stat) ** -0.5))).astype(np.float32)


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, place: np.ndarray, value: np.ndarray) -> float:
        vx = self.factor[place] * value[:, None]
        return float(self.bias + self.weight[place] @ value + 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx**2).sum()))

    def score(self, text: str | None, recorded: int | None = None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*features(text, recorded)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Logistic loss, minimised by AdaGrad over shuffled batches."""
    g = np.random.Generator(np.random.PCG64(SEED))
    weight, factor = np.zeros(SIZE, np.float32), g.normal(0, 0.05, (SIZE, RANK)).astype(np.float32)
    if not len(rows):
        return Machine(0.0, weight, factor * 0)
    mean = np.clip(labels.mean(), 0.01, 0.99)
    bias, seen_w, seen_v = float(np.log(mean / (1 - mean))), np.full(SIZE, 1e-4, np.float32), np.full((SIZE, RANK), 1e-4, np.float32)
    for _ in range(-(-UPDATES * BATCH // len(rows))):
        order = g.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            size = np.array([len(rows[k][0]) for k in pick])
            place, value = np.concatenate([rows[k][0] for k in pick]), np.concatenate([rows[k][1] for k in pick])
            first = np.cumsum(size) - size
            vx = factor[place] * value[:, None]
            total = np.add.reduceat(vx, first)
            raw = bias + np.add.reduceat(weight[place] * value, first) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat(vx**2, first).sum(axis=1))
            off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]) / len(pick)
            own = np.repeat(off, size)
            here, back = np.unique(place, return_inverse=True)
            gw = np.bincount(back, own * value) + DECAY * weight[here]
            inner = (own * value)[:, None] * (np.repeat(total, size, axis=0) - vx)
            gv = np.stack([np.bincount(back, inner[:, f]) for f in range(RANK)], axis=1) + DECAY * factor[here]
            seen_w[here] += gw**2
            seen_v[here] += gv**2
            weight[here] -= RATE * gw / np.sqrt(seen_w[here])
            factor[here] -= RATE * gv / np.sqrt(seen_v[here])
            bias -= RATE * float(off.sum())
    return Machine(bias, weight, factor)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine fitted on about `sample` labelled rows outside the held-out fifth."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = usable.count()
    if n > sample:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(sample / n * (1 << 20)))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("_label"))  # about `sample` rows, so that it may be broadcast

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [features(t, r) for t, r in zip(b["text"], b["n_chars"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["_label"], "place": [p.tobytes() for p, _ in x], "value": [v.tobytes() for _, v in x]})

    # As bytes, of which the driver reads the numbers where they lie: as arrays each number becomes an object of its own on the way.
    rows = docs.select("doc_id", "text", measured(docs).alias("n_chars")).join(F.broadcast(chosen), "doc_id").mapInPandas(run, "doc_id long, label int, place binary, value binary").toPandas()
    rows = rows.sort_values(["doc_id", "label"], kind="stable")
    machine = fit([(np.frombuffer(p, np.int32), np.frombuffer(v, np.float32)) for p, v in zip(rows["place"], rows["value"])], rows["label"].to_numpy(float))
    del rows
    released()
    return machine


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with a column score; an own column of that name is called own_score. Without a column n_chars, texts are measured."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a fixed size, whatever the input

    @F.pandas_udf("double")
    def score(text: pd.Series, recorded: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t, r) for t, r in zip(text, recorded)], dtype=float)

    docs = apart(docs, ("score",))[0]
    return docs.withColumn("score", score(F.col("text"), measured(docs)))


def measured(docs: DataFrame) -> Column:
    return F.col("n_chars") if "n_chars" in docs.columns else F.length("text").cast("long")


def accepted(docs: DataFrame, machine: Machine, least: float = 0.3) -> DataFrame:
    """The rows of docs that score `least` or more, in the columns of docs."""
    names = apart(docs, ("score",))[1]
    return scored(docs, machine).where(F.col("score") >= least).select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = trained(docs, table(spark, sf_dir, "labels"))
    return scored(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
