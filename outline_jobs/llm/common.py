"""What the operators share: reading tables, the shared folder, words as hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold more than one HUBS-th of all rows are hubs; there are fewer than HUBS of them.
HUBS = 1024
#: Bytes that end a word: ASCII other than letters and digits. All other bytes belong to words.
WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: The same rule as a pattern for SQL and Python, on lower-cased text.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: White space as the result contracts have it.
SPACE = r"[\x20\x09-\x0D]"

_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes handled at once; only a longer single word needs more.
WINDOW = 1 << 20


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, under spark.checkpoint.dir.

    Only where a session on one machine has no such setting, as in tests, is a temporary one made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def looked_up(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows with the columns of facts of their keys, rows without facts left out; facts has one row for each key, and in _n how many of the rows hold it.

    total: at least the number of rows. Rows of hubs meet a broadcast of fewer than HUBS facts where they lie; only the others are shuffled,
    so no task gets more of a key than a HUBS-th. Keys are never null.
    """
    hub = F.broadcast(facts.where(F.col("_n") * HUBS > total).withColumn("_hub", F.lit(True)))
    marked = rows.join(hub, keys, "left")
    rest = marked.where("_hub is null").select(*rows.columns).join(facts, keys)
    return rest.unionByName(marked.where("_hub").drop("_hub")).drop("_n")


def apart(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """(docs whose own columns of these names are called own_..., what each of its columns is called then): room for an operator's results.

    Names are the same where they differ in case alone, as Spark has it.
    """
    taken, found = {n.lower() for n in names}, []
    every = {c.lower() for c in docs.columns}
    for c in docs.columns:
        new = c
        while new.lower() in taken or (new != c and new.lower() in every):
            new = f"own_{new}"
        taken.add(new.lower())
        found.append(new)
    return docs.toDF(*found), found


def packed(docs: DataFrame, left_out: tuple[str, ...] = ()) -> Column:
    """The caller's columns as one struct _row, so that no working name of an operator meets theirs."""
    without = {c.lower() for c in left_out}
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in without]).alias("_row")


def unpacked(columns: list[str], names: list[str]) -> list[Column]:
    """The columns of _row under these names."""
    return [F.col(f"_row.`{c}`").alias(n) for c, n in zip(columns, names)]


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Within it, what runs passes Arrow batches of at most about this many bytes to Python workers; the session's own setting returns after it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def released() -> None:
    """Gives memory that earlier work of this worker has freed back to the machine, where its C library can."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def put(folder: str, name: str, content: bytes) -> None:
    """Writes a file of the shared folder under its name in one move."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    task = TaskContext.get()
    part = f"{root}/_{name}.{task.taskAttemptId() if task else 0}"
    with store.open_output_stream(part) as f:
        f.write(content)
    store.move(part, f"{root}/{name}")


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of the lower-cased text, in order."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    inside = WORD_BYTE[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(raw) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(raw) and inside[-1]:
        edge = np.concatenate((edge, [len(raw)]))
    start, end = edge[0::2], edge[1::2]
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + WINDOW, "right")))
        a, b = start[i], end[j - 1]
        up, down = _powers(WINDOW if b - a <= WINDOW else int(b - a))
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[raw[a:b]] * up[: b - a], out=total[1:])
        out[i:j] = (total[end[i:j] - a] - total[start[i:j] - a]) * down[start[i:j] - a]
        i = j
    return mixed(out)


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """A hash of every n words in a row; of all words where there are fewer; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
    return mixed(total + np.uint64(n))
