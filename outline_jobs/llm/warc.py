"""WARC archives whose records are single Zstandard frames that share a dictionary.

Each file starts with a skippable frame (magic number 0x184D2A5D) that holds the dictionary built from the file's own
records; every record follows as a frame of its own, so that one can be read by its offset alone. Files
are cut at FILE_BYTES of records, so a task holds one file's records and no more.

Of records with equal payloads of at least min_bytes, the one with the smallest key is the response, the
others revisit it; which is which comes from keys and digests alone, grouped with partial sums. Records are written in the order of their keys within a task, so a
task that runs again writes the same files under the same names, each moved into place when it is complete.

Defined cases. Null html is an empty payload. A null url is written as the record's own name. Rows equal in key
and payload are each written as responses. A null key sorts last and is never referred to unless all keys of its payload are null.
Empty tables give no files. Extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outline_jobs.llm.common import put, shared_dir, table

# Fixed values of the WARC and Zstandard formats.
DICT_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILE_BYTES = 32_000_000
DICT_BYTES = 65_536
#: Bytes of records, spread over the file, from which its dictionary is built, and of each record at most; records themselves are always whole.
SAMPLE_BYTES, SAMPLE_RECORD = 4_000_000, 65_536


def decided(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """key, url, payload (null for revisits), n_bytes, digest (hex), refers_to (null for responses), is_revisit."""
    p = pages.select(F.col("page_id").alias("key"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumns({"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    # Keys and digests alone decide. Payloads then move once, by key and digest, so a payload that a third of the pages share is no hot key.
    slim = p.select("key", "digest", "n_bytes").where(F.col("n_bytes") >= min_bytes)
    first = slim.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = slim.groupBy("key", "digest").agg(F.lit(1).alias("_n")).drop("_n").join(first, "digest").where(F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")))
    again = again.select(F.col("key").alias("_key"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to"))
    joined = p.join(again.hint("merge"), p["key"].eqNullSafe(again["_key"]) & (p["digest"] == again["_digest"]), "left")
    visited = F.col("refers_to").isNotNull()
    return joined.select("key", "url", F.when(~visited, F.col("payload")).alias("payload"), "n_bytes", "digest", "refers_to", visited.alias("is_revisit"))


def name_of(key: int | None) -> str:
    return f"<urn:x-page:{'' if key is None else key}>"


def record_bytes(key, url, payload, n_bytes, digest, refers_to, date: str) -> bytes:
    """A whole record, headers and block."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name_of(key)}", f"WARC-Date: {date}"]
    head.append("WARC-Target-URI: " + (name_of(key)[1:-1] if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name_of(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]):
    """A Zstandard dictionary from records spread over the list; their raw bytes where they are too few to train on."""
    import zstandard

    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = [r[:SAMPLE_RECORD] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample, k=256, d=8, level=3)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICT_BYTES] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def file_bytes(records: list[bytes]) -> tuple[bytes, list[tuple[int, int]]]:
    """One archive, and where each record's frame begins and how long it is."""
    import zstandard

    shared = dictionary(records)
    raw = shared.as_bytes()
    press = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True)
    parts, at, places = [struct.pack("<II", DICT_FRAME, len(raw)) + raw], 8 + len(raw), []
    for r in records:
        frame = press.compress(r)
        places.append((at, len(frame)))
        parts.append(frame)
        at += len(frame)
    return b"".join(parts), places


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives and returns their index as written beside them: key, file, offset, length."""
    rows = decided(pages, min_bytes).sortWithinPartitions("key", "digest")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, keys, records, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            nonlocal n, keys, records, held
            name = f"part-{part:06d}-{n:04d}.warc.zst"
            content, places = file_bytes(records)
            put(folder, name, content)
            out = pd.DataFrame({"key": pd.array(keys, dtype="Int64"), "file": name, "offset": [p[0] for p in places], "length": [p[1] for p in places]})
            n, keys, records, held = n + 1, [], [], 0
            return out

        for batch in batches:
            for key, url, payload, n_bytes, digest, refers_to, again in batch.itertuples(index=False):
                records.append(record_bytes(None if pd.isna(key) else int(key), url, payload, n_bytes, digest, int(refers_to) if again else None, date))
                keys.append(None if pd.isna(key) else int(key))
                held += len(records[-1])
                if held >= FILE_BYTES:
                    yield flush()
        if records:
            yield flush()

    index = rows.select("key", "url", "payload", "n_bytes", "digest", "refers_to", "is_revisit").mapInPandas(run, "key long, file string, offset long, length long")
    index.write.parquet(folder + "-index")
    return pages.sparkSession.read.parquet(folder + "-index")


def opened(content: bytes):
    """A reader of the records' bytes, one after the other."""
    import zstandard

    magic, size = struct.unpack_from("<II", content)
    if magic != DICT_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    shared = zstandard.ZstdCompressionDict(content[8 : 8 + size])
    return zstandard.ZstdDecompressor(dict_data=shared).stream_reader(io.BytesIO(memoryview(content)[8 + size :]), read_across_frames=True)


def headers(f) -> dict[str, str] | None:
    """The header lines up to the empty one; None at the end of the file."""
    first = f.readline()
    if not first:
        return None
    out = {"": first.decode().strip()}
    while line := f.readline().rstrip(b"\r\n"):
        k, _, v = line.partition(b":")
        out[k.decode().lower()] = v.strip().decode()
    return out


def parsed(content: bytes) -> Iterator[dict]:
    """The records of one archive. Payloads of responses are digested again; revisits carry what their headers say."""
    f = io.BufferedReader(opened(content), 1 << 20)
    number = lambda name: int(x) if (x := name.rpartition(":")[2].rstrip(">")) else None
    while (h := headers(f)) is not None:
        block = f.read(int(h["content-length"]))
        f.read(4)
        inner = io.BytesIO(block)
        http = headers(inner)
        row = {"page_id": number(h["warc-record-id"]), "record_type": h["warc-type"], "url": h["warc-target-uri"], "refers_to": None, "payload": None}
        if h["warc-type"] == "response":
            payload = inner.read()
            row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}
        else:
            row |= {"refers_to": number(h["warc-refers-to"]), "payload_bytes": int(http["content-length"]), "payload_digest": h["warc-payload-digest"].removeprefix("sha1:")}
        yield row


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives of a folder: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null without payloads)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for r in parsed(content):
                    rows.append(r if payloads else r | {"payload": None})
                    if payloads and len(rows) == 1000:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows)[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]]
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def read_record(folder: str, file: str, offset: int, length: int) -> dict:
    """One record by its place in the index, without reading the rest of its file but the dictionary."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{file}") as f:
        magic, size = struct.unpack("<II", f.read(8))
        shared = f.read(size)
        f.seek(offset)
        return next(parsed(struct.pack("<II", magic, size) + shared + f.read(length)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = shared_dir(spark, "warc")
    if not write_archives(pages, folder).take(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS d, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
b AS (SELECT *, unnest(range(8)) AS i FROM p),
v AS (SELECT *, CAST('0x' || substr(d, i * 5 + 1, 5) AS BIGINT) AS x FROM b),
s AS (SELECT page_id, string_agg(list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> k) & 31)::INT + 1, 1) for k in [15, 10, 5, 0]], 'string_agg', ''), '' ORDER BY i) AS payload_digest FROM v GROUP BY page_id)
SELECT p.page_id, payload_bytes, payload_digest, CASE WHEN p.page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> first THEN first END AS refers_to FROM p JOIN s ON s.page_id = p.page_id
"""
