"""Token ids in files compressed by a Re-Pair grammar per shard.

Documents are range-partitioned by doc_id and sorted, so that files in the order of their names hold ascending doc_ids.
A shard of SHARD_TOKENS ids or more repeatedly replaces frequent neighbouring ids by a new symbol: first within distinct words weighted by how
often each occurs, which are as good as the sequence itself for pairs that lie inside words, then over the whole sequence, each until no pair occurs twice. No pair
includes the end id, so every document is a run of whole symbols. The file keeps the rules, each symbol's expansion length, and the
documents' places, so that any ids of any document are decoded by descent: only rules on the way to them are looked at.

The tokenizer drops white space and cuts at it, so distinct words are encoded once per worker and looked up after that; cutting and looking up are Arrow's.

Defined cases. Null is the empty text: the end id alone. Rows with one doc_id are ordered by text and each written. A null doc_id sorts
first. Rows of one doc_id, or without any, are dealt to tasks by the beginning of their texts (PREFIX code points) too. Empty tables give no files and empty results. Extra columns are left out.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outline_jobs.llm.common import batches_of, put, released, shared_dir, table

MAGIC = b"RPR2"
#: Ids of a shard, at least, but for the last of a task; bytes of the table of words that a worker keeps; words encoded as one text; bytes of texts cut at once.
SHARD_TOKENS, WORD_BYTES, LINE, TEXT_BYTES = 1_000_000, 32 << 20, 200, 4 << 20
#: Code points of a text by which rows of one doc_id are dealt to tasks.
PREFIX = 64
#: The only floor: occurrences of a pair without which it gets no rule, in both phases. Two are as few as can repeat, so nothing that repeats is left.
LEAST = 2
END = 2
WORD_END = "</w>"
#: How the tokenizer cuts lower-cased text; a fixed value of its file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: ASCII signs that end a word after a letter (but the one whose small form ends in a sign) are pieces of their own; an apostrophe may belong to either side.
ENDING = r"([^\P{L}\x{130}])([!-&(-/:-@\[-`{-~]+)(\s|$)"
#: One piece: letters alone.
LETTERS = r"^\p{L}+$"
#: What keeps the pieces of a word from being counted by PIECES: other than Latin letters, a letter that lower case makes two, white space that isn't ASCII, special tokens.
WHOLE = r"[\x1c-\x1f\x{85}\x{a0}\x{130}\x{250}-\x{10ffff}]|<\|"


def cut_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words at whose ends the tokenizer cuts, number of words of each text): by ASCII white space, and before ASCII signs that end a word.

    ASCII letters are made small, as the tokenizer does it. Texts that may hold special tokens, which it looks for before, are cut by white space alone.
    """
    apart = pc.replace_substring_regex(pc.ascii_lower(texts), ENDING, r"\1 \2\3")
    split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, apart))
    words, n = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    # White space at a text's ends leaves empty words.
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))[np.concatenate(([0], np.cumsum(n)))]
    return words.filter(full), np.diff(before)


class Encoder:
    """Ids of words, each distinct word encoded once.

    Words and ids lie in flat arrays, about 30 bytes a word, so WORD_BYTES bound what a worker keeps. New words whose number of pieces is known go through the
    library LINE at a time as one text, which is cut back into words by that number, as each piece ends with an id that ends a word; others go through it one by one.
    Words of letters alone, most of them, go through the same model without the normaliser.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For words of small Latin letters nothing is left to normalise or to cut.
        self.lettered = Tokenizer(self.tokenizer.model)
        self.lettered.normalizer = normalizers.Sequence([])
        self.lettered.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.size = self.tokenizer.get_vocab_size()
        self.last = np.zeros(self.size, bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(WORD_END)]] = True
        self.reset()

    def reset(self) -> None:
        self.words = pa.array([""], pa.string())  # the empty word stands for the end of a document
        self.ids, self.n = np.array([END], np.int32), np.array([1], np.int32)

    def nbytes(self) -> int:
        return self.words.nbytes + self.ids.nbytes + self.n.nbytes

    def encode(self, texts: list[str], by) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        found = [e.ids for e in by.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(n.sum())), n

    def learn(self, words: pa.Array) -> np.ndarray:
        """Adds words to the table; in which order."""
        known = pc.invert(pc.match_substring_regex(words, WHOLE))
        letters = pc.and_(known, pc.match_substring_regex(words, LETTERS)).to_numpy(zero_copy_only=False)
        pieces = np.where(known.to_numpy(zero_copy_only=False), pc.count_substring_regex(words, PIECES).to_numpy(), 0)
        order, kept_ids, kept_n, alone = [], [], [], [np.flatnonzero(pieces == 0)]
        for rows, texts, by in ((np.flatnonzero(letters), pc.utf8_lower(words), self.lettered), (np.flatnonzero((pieces > 0) & ~letters), words, self.tokenizer)):
            edge = np.append(np.arange(0, len(rows), LINE, np.int32), np.int32(len(rows)))
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(edge), texts.take(pa.array(rows))), " ").to_pylist()
            ids, n = self.encode(lines, by)
            for a, b, line in zip(edge, edge[1:], np.split(ids, np.cumsum(n)[:-1])):
                ends, count = np.flatnonzero(self.last[line]), np.cumsum(pieces[rows[a:b]])
                if len(ends) != count[-1] or ends[-1] + 1 != len(line):
                    alone.append(rows[a:b])
                    continue
                order.append(rows[a:b])
                kept_ids.append(line)
                kept_n.append(np.diff(ends[count - 1], prepend=-1))
        order += alone
        ids, n = self.encode(words.take(pa.array(np.concatenate(alone))).to_pylist(), self.tokenizer)
        self.words = pa.concat_arrays([self.words, words.take(pa.array(np.concatenate(order)))])
        self.ids = np.concatenate([self.ids, *kept_ids, ids]).astype(np.int32)
        self.n = np.concatenate([self.n, *kept_n, n]).astype(np.int32)
        return np.concatenate(order)

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place of every word in the table, the end of each text among them; number of places of each text)."""
        words, n = cut_texts(texts)
        coded = words.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.words)
        new = coded.dictionary.filter(found.is_null())
        found = pc.fill_null(found, -1).to_numpy().copy()
        at = np.flatnonzero(found < 0)
        for i in range(0, len(new), 50_000):
            few = at[i : i + 50_000]
            order = self.learn(new.slice(i, 50_000))
            found[few[order]] = np.arange(len(self.n) - len(few), len(self.n))
        out = np.zeros(len(words) + len(n), np.int32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(n + 1) - 1] = False
        out[inner] = found[coded.indices.to_numpy()]
        return out, n + 1


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def winners(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the pairs at these places, in ascending order, are replaced where they overlap: the higher rank first."""
    won = np.zeros(len(at), bool)
    left = np.arange(len(at))
    while len(left):
        a, r = at[left], rank[left]
        touch = np.diff(a) == 1
        best = np.ones(len(left), bool)
        best[1:] &= ~touch | (r[1:] > r[:-1])
        best[:-1] &= ~touch | (r[:-1] > r[1:])
        won[left[best]] = True
        gone = best.copy()
        gone[1:] |= touch & best[:-1]
        gone[:-1] |= touch & best[1:]
        left = left[~gone]
    return won


def by_pair(symbols: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(the pairs at these places in ascending order, the place of each). Pair and place are sorted as one number where they fit into one."""
    keys, shift = symbols[at] << bits | symbols[at + 1], len(symbols).bit_length()
    if 2 * bits + shift < 64:
        both = np.sort(keys << shift | at)
        return both >> shift, both & ((1 << shift) - 1)
    order = np.argsort(keys, kind="stable")
    return keys[order], at[order]


def ruled(symbols: np.ndarray, joins: np.ndarray, weights: np.ndarray | None, next_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replaces pairs until none occurs LEAST times. joins: whether place i may pair with i + 1; weights: of places. (symbols, places they come from, rules).

    Every round replaces all pairs that occur LEAST times, where they overlap the more frequent one, those used less than LEAST times by then excepted; the first
    of them is used wherever it occurs, so no round is in vain. A place whose pair is too rare is left alone until one of its two symbols changes: a pair of
    old symbols never becomes more frequent.
    """
    places, rules, live, bits = np.arange(len(symbols)), [np.empty((0, 2), np.int64)], joins.copy(), int(next_rule + len(symbols)).bit_length()
    while True:
        at = np.flatnonzero(live)
        # Of a run of one symbol every other place counts.
        same = at[symbols[at] == symbols[at + 1]]
        if len(same):
            run = np.concatenate(([True], np.diff(same) > 1))
            start = same[np.maximum.accumulate(np.where(run, np.arange(len(same)), 0))]
            use = live.copy()
            use[same[(same - start) % 2 == 1]] = False
            at = np.flatnonzero(use)
        if not len(at):
            break
        keys, where = by_pair(symbols, at, bits)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.diff(first, append=len(keys))
        count = n if weights is None else np.add.reduceat(weights[where], first)
        often = count >= LEAST
        live[where[np.repeat(~often, n)]] = False
        good = np.flatnonzero(often)
        if not len(good):
            break
        good = good[np.lexsort((good * 0x9E3779B1 & 0xFFFFF, count[good]))]
        rank = np.full(len(first), -1)
        rank[good] = np.arange(len(good))
        own = np.full(len(symbols), -1)
        own[where] = np.repeat(rank, n)
        at = np.flatnonzero(own >= 0)
        own = own[at]
        won = winners(at, own)
        at, own = at[won], own[won]
        uses = np.bincount(own, None if weights is None else weights[at], len(good))
        enough = uses >= LEAST
        some = enough[own]
        at, own = at[some], own[some]
        pair = keys[first[good[enough]]]
        rules.append(np.stack([pair >> bits, pair & ((1 << bits) - 1)], axis=1))
        symbols[at] = next_rule + (np.cumsum(enough) - 1)[own]
        kept = np.ones(len(symbols), bool)
        kept[at + 1] = False
        # The new symbol joins what follows as the second of its two did.
        joins[at] = joins[at + 1]
        symbols, places, joins, live = symbols[kept], places[kept], joins[kept], live[kept]
        weights = None if weights is None else weights[kept]
        at = at - np.arange(len(at))
        live[at] = joins[at]
        before = at[at > 0] - 1
        live[before] = joins[before]
        next_rule += int(enough.sum())
    return symbols, places, np.concatenate(rules)


def compress(words: np.ndarray, n_words: np.ndarray, ids: np.ndarray, n_ids: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules as pairs, symbols of each document, ids of each document) of documents given as places of words in a table of ids."""
    used = np.zeros(len(n_ids), bool)
    used[words] = True
    own, sequence = np.flatnonzero(used), (np.cumsum(used) - 1)[words]
    begin = (np.cumsum(n_ids, dtype=np.int64) - n_ids)[own]
    size = n_ids[own].astype(np.int64)
    count = np.bincount(sequence).astype(float)
    first_word = np.cumsum(n_words) - n_words
    total = np.add.reduceat(size[sequence], first_word)
    word = np.repeat(np.arange(len(own)), size)
    symbols = ids[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(len(word))].astype(np.int64)
    joins = np.append((word[:-1] == word[1:]) & (symbols[:-1] != END) & (symbols[1:] != END), False)
    symbols, places, rules = ruled(symbols, joins, count[word], first_rule)
    size = np.bincount(word[places], minlength=len(own))
    begin = np.cumsum(size) - size
    n = size[sequence]
    symbols = symbols[np.repeat(begin[sequence] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    doc = np.repeat(np.arange(len(n_words)), np.add.reduceat(n, first_word))
    joins = np.append((symbols[:-1] != END) & (symbols[1:] != END), False)
    symbols, places, more = ruled(symbols, joins, None, first_rule + len(rules))
    return symbols, np.concatenate([rules, more]), np.bincount(doc[places], minlength=len(n_words)), total


def expansion_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """How many ids each rule stands for; rules only use rules before them, so rounds of doubling reach them all."""
    out = np.ones(len(rules), np.int64)
    while True:
        side = np.where(rules >= first_rule, out[np.maximum(rules - first_rule, 0)], 1)
        now = side.sum(axis=1)
        if (now == out).all():
            return out
        out = now


def packed(symbols: np.ndarray, rules: np.ndarray, first_rule: int, doc_ids: list[int | None], n_symbols: np.ndarray, n_ids: np.ndarray) -> bytes:
    """A file's content; documents without an id are marked by one byte each."""
    width = 2 if first_rule + len(rules) <= 1 << 16 else 3 if first_rule + len(rules) <= 1 << 24 else 4
    head = struct.pack("<4sIQQQI", MAGIC, first_rule, len(rules), len(doc_ids), len(symbols), width)
    body = [rules.astype("<u4"), expansion_lengths(rules, first_rule).astype("<u4"), np.array([k or 0 for k in doc_ids], "<i8"), np.array([k is None for k in doc_ids], "u1"), n_symbols.astype("<u4"), n_ids.astype("<u4")]
    return head + b"".join(x.tobytes() for x in body) + symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


class Shard:
    """A file's content, decoded where asked."""

    def __init__(self, content: bytes):
        magic, self.first_rule, n_rules, n_docs, n, self.width = struct.unpack_from("<4sIQQQI", content)
        if magic != MAGIC:
            raise ValueError("not a file of this format")
        at = struct.calcsize("<4sIQQQI")

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, count, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.lengths, self.doc_ids, self.no_id = take("<u4", n_rules).astype(np.int64), take("<i8", n_docs), take("u1", n_docs).astype(bool)
        self.n_symbols, self.n_ids = take("<u4", n_docs).astype(np.int64), take("<u4", n_docs).astype(np.int64)
        raw = np.zeros((n, 4), np.uint8)
        raw[:, : self.width] = take("u1", n * self.width).reshape(n, self.width)
        self.symbols = raw.view("<u4")[:, 0].astype(np.int64)
        self.first = np.cumsum(self.n_symbols) - self.n_symbols
        self._flat: tuple[np.ndarray, np.ndarray] | None = None
        self.rules_read = 0

    def _flatten(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rules one after the other, where each begins): rules by rising depth, as each copies what its two symbols stand for."""
        inner = self.rules >= self.first_rule
        child = np.where(inner, self.rules - self.first_rule, 0)
        depth = np.zeros(len(self.rules), np.int64)
        while True:
            now = np.where(inner, depth[child] + 1, 0).max(axis=1, initial=0)
            if (now == depth).all():
                break
            depth = now
        size = np.where(inner, self.lengths[child], 1)
        begin = np.cumsum(self.lengths) - self.lengths
        to = np.stack([begin, begin + size[:, 0]], axis=1)
        flat = np.empty(int(self.lengths.sum()), np.int64)
        flat[to[~inner]] = self.rules[~inner]
        order = np.argsort(depth, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
            some = inner[rows]
            source, target, n = begin[child[rows][some]], to[rows][some], size[rows][some]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            flat[np.repeat(target, n) + step] = flat[np.repeat(source, n) + step]
        return flat, begin

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for, for reading a whole file: all its rules are expanded once."""
        if not len(self.rules):
            return symbols
        self._flat = self._flat or self._flatten()
        flat, begin = self._flat
        big = symbols >= self.first_rule
        rule = np.where(big, symbols - self.first_rule, 0)
        n = np.where(big, self.lengths[rule], 1)
        start = np.cumsum(n) - n
        m = n[big]
        # Where each id comes from: for a rule's ids the rule's place, shifted from the place here.
        out = flat[np.repeat(np.where(big, begin[rule] - start, -start), n) + np.arange(int(n.sum()))] if len(m) else symbols.copy()
        out[start[~big]] = symbols[~big]
        return out

    def ids(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the doc-th document: symbols before them are skipped by their lengths, and so are sides of rules on the way down."""
        own = self.symbols[self.first[doc] : self.first[doc] + self.n_symbols[doc]]
        stop = int(self.n_ids[doc]) if stop is None else min(stop, int(self.n_ids[doc]))
        if start >= stop:
            return np.empty(0, np.int64)
        n = np.where(own >= self.first_rule, self.lengths[np.maximum(own - self.first_rule, 0)], 1) if len(self.rules) else np.ones(len(own), np.int64)
        edge = np.concatenate(([0], np.cumsum(n)))
        a = int(np.searchsorted(edge, start, "right")) - 1
        return self._descended(own[a:], start - int(edge[a]), stop - start)

    def _descended(self, symbols: np.ndarray, skip: int, count: int) -> np.ndarray:
        """count ids of what symbols stand for, after the first skip; rules_read counts the rules opened."""
        out, todo, at = np.empty(count, np.int64), [], 0
        rest = iter(symbols.tolist())
        while at < count:
            symbol = todo.pop() if todo else next(rest)
            rule = symbol - self.first_rule
            length = int(self.lengths[rule]) if rule >= 0 else 1
            if length <= skip:
                skip -= length
            elif rule < 0:
                out[at] = symbol
                at += 1
            else:
                self.rules_read += 1
                left, right = self.rules[rule].tolist()
                todo += (right, left)
        return out


def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about TEXT_BYTES."""
    block = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False), dtype=np.int64) // TEXT_BYTES
    edge = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(batch)]
    return (batch.slice(a, b - a) for a, b in zip(edge, edge[1:]))


def write_ids(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Writes the shards and returns their list: part, shard, file, first_id, n_docs, n_tokens."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.left("text", F.lit(PREFIX))).sortWithinPartitions("doc_id", "text")
    kind = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        enc, part, shard = encoder(tokenizer), TaskContext.get().partitionId(), 0
        keys, words, counts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, keys, words, counts, held
            symbols, rules, n_symbols, n_ids = compress(np.concatenate(words), np.concatenate(counts), enc.ids, enc.n, enc.size)
            name = f"part-{part:06d}-{shard:04d}.rpr"
            put(folder, name, packed(symbols, rules, enc.size, keys, n_symbols, n_ids))
            released()
            out = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "file": name, "n_docs": len(keys), "n_tokens": int(n_ids.sum())}], schema=kind)
            shard, keys, words, counts, held = shard + 1, [], [], [], 0
            return out

        for batch in batches:
            for few in blocks(batch):
                if enc.nbytes() > WORD_BYTES:  # what is held refers to the words known so far
                    if keys:
                        yield flush()
                    enc.reset()
                found, n = enc.places(few["text"])
                keys += few["doc_id"].to_pylist()
                words.append(found)
                counts.append(n)
                held += int(enc.n[found].sum())
                if held >= SHARD_TOKENS:
                    yield flush()
        if keys:
            yield flush()

    with batches_of(docs.sparkSession, TEXT_BYTES):
        rows.mapInArrow(run, "part int, shard int, file string, n_docs long, n_tokens long").write.parquet(folder + "-list")
    return docs.sparkSession.read.parquet(folder + "-list")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of a folder of shards: file, doc_id, place (ids before it in its file), n_tokens, ids_crc32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                s = Shard(content)
                edge, rows = np.concatenate(([0], np.cumsum(s.n_symbols))), []
                for a in range(0, len(s.doc_ids), 256):  # a block of documents at a time
                    b = min(a + 256, len(s.doc_ids))
                    ids = s.expand(s.symbols[edge[a] : edge[b]]).astype("<u4")
                    cut = np.concatenate(([0], np.cumsum(s.n_ids[a:b])))
                    rows += [zlib.crc32(ids[x:y]) for x, y in zip(cut[:-1], cut[1:])]
                yield pd.DataFrame({"file": path.rpartition("/")[2], "doc_id": pd.arrays.IntegerArray(s.doc_ids.astype(np.int64), s.no_id), "place": np.cumsum(s.n_ids) - s.n_ids, "n_tokens": s.n_ids, "ids_crc32": rows})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rpr").load(folder)
    return files.select("path", "content").mapInPandas(run, "file string, doc_id long, place long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the documents' ids and returns what the files hold: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "ids")
    shards = write_ids(docs, folder, tokenizer)
    if not shards.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    # Ids before each part, then before each shard of a part: only one row for each task meets in one place.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_part"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    starts = shards.withColumn("_own", own).join(before, "part").select("file", (F.col("_part") + F.col("_own")).alias("_start"))
    return read_digests(spark, folder).join(starts, "file").select("doc_id", (F.col("_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), tokenizer_path())
