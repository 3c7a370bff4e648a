import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from outline_jobs.llm import filter_audit, sharding, vector_codes

DOCS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>, label int, error string, _key int, Code int, _own int"


def texts():
    r = random.Random(5)
    parts = ["a", "Be", "CAT", "dé", "日本語", "x" * 70, "x" * 69 + "y", "#", "a|b", "𝒳", "\x1c", " z", ""]
    out = ["", " ", "\t\n", "A", "one", " lead", "trail ", "é", "　"]
    out += ["".join(r.choice(parts) + r.choice([" ", "\n", "\x0b", "", "  "]) for _ in range(r.randint(1, 260))) for _ in range(120)]
    return out + [" ".join(f"w{k}" for k in range(n)) for n in (99, 100, 60_000)] + [" ".join(f"w{k % m}" for k in range(100)) for m in (79, 80)] + ["B" * k + "b" * 90 for k in (9, 10, 11)]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_transducer_measures():
    every = texts()
    raw = "".join(every).encode()
    got = filter_audit.measures(np.frombuffer(raw, np.uint8), np.cumsum([len(t.encode()) for t in every]))
    for k, t in enumerate(every):
        w = words(t)
        assert [int(got[c][k]) for c in ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_points")] == [
            len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(re.findall("[#$%&*|]", t)), len(t)]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(filter_audit, "_span_hashes", lambda raw, loads, start, size, text: np.zeros(len(start), np.uint64))
    body = [b"ab cd ab ef cd", b"ab ab " + b"q" * 80 + b" " + b"q" * 79 + b"r " + b"q" * 80]
    got = filter_audit.measures(np.frombuffer(b"".join(body), np.uint8), np.cumsum([len(b) for b in body]))
    assert list(got["n_words"]) == [5, 5] and list(got["n_distinct"]) == [3, 3]


def test_audit_against_every_order(spark):
    r = random.Random(6)
    every = texts()
    rows = [(i, every[i % len(every)] if r.random() < 0.9 else None, r.choice(["en", "de", "", None]), "s") for i in range(200)]
    rows += [(3, "copy", "en", "s"), (3, "copy", "en", "s"), (None, "copy", "de", "s"), (None, None, None, None), (4, "copy", "en", "s")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 200, 2)] + [(2, 1, 1), (None, 1, 1)]
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    failed = []
    for i, t, part, _ in rows:
        t = t or ""
        w = words(t)
        tests = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]]
        failed.append((i, part or "", {f for f, bad in zip("ABCDE", tests) if bad}))
    want, shapley = {}, Counter()
    for part in {p for _, p, _ in failed}:
        for order in map("".join, permutations("ABCDE")):
            left = [(i, bad) for i, p, bad in failed if p == part]
            inside = left
            for step, f in enumerate(order, 1):
                gone = [(i, bad) for i, bad in left if f in bad]
                left = [(i, bad) for i, bad in left if f not in bad]
                failing = [bad for _, bad in inside if f in bad]
                shapley[part, f] += len(gone)
                want[part, order, step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(bad == {f} for bad in failing), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    got = filter_audit.audit(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as _mask", "2 as n_words", "3 as step"), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(want)
    for g in got:
        k = g["part"], g["filter_order"], g["step"]
        assert want[k] == [g[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")]
        assert g["shapley"] == shapley[g["part"], g["filter_order"][g["step"] - 1]]
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def brute_codes(kept):
    """By the definition, with Python integers; kept: (id, integers)."""
    first = sorted(kept, key=lambda x: (x[0] is None, x[0] or 0, x[1]))[:64]
    n = len(first[0][1]) // 16
    books = [[list(v[p * n : p * n + n]) for _, v in first] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(v[p * n : p * n + n], books[p][e]), e)) for p in range(16)] for _, v in kept]
    for _ in range(2):
        codes = assign()
        for p in range(16):
            mine = defaultdict(list)
            for (_, v), c in zip(kept, codes):
                mine[c[p]].append(v[p * n : p * n + n])
            for e, vs in mine.items():
                books[p][e] = [sum(x) // len(vs) for x in zip(*vs)]
    codes = assign()
    errors = [sum(far(v[p * n : p * n + n], books[p][c[p]]) for p in range(16)) for (_, v), c in zip(kept, codes)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return ["".join(f"{c:02x}" for c in code) for code in codes], errors, sha


@pytest.mark.parametrize("n", [3, 150])
def test_codes_against_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(vector_codes, "CHUNK", 32)
    r = random.Random(n)
    rows = [(i, [float(np.float32(r.gauss(0, 0.3))) for _ in range(32)], r.choice([1, 2, None])) for i in range(n)]
    rows += [rows[1], rows[1], (None, rows[0][1], 7), (n, [1000.0] * 16 + [-1000.0] * 16, None)]
    bad = [(n + 1, None, 1), (n + 2, [None] * 32, 1), (n + 3, [math.nan] + [0.0] * 31, 1), (-1, [math.inf] + [0.0] * 31, 1)]
    r.shuffle(rows)
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows]
    codes, errors, sha = brute_codes(kept)
    total = Counter()
    for (_, _, label), e in zip(rows, errors):
        total[label] += e
    want = Counter((i, c, e, total[label], sha) for (i, _, label), c, e in zip(rows, codes, errors))
    short = (n + 9, [0.5] * 5, 99)
    df = spark.createDataFrame([(*x, f"e{x[0]}", 7, 8, 9) for x in [*rows, *bad, short]], VECTORS)
    out = vector_codes.coded(df)
    assert out.columns == ["vec_id", "label", "own_error", "_key", "own_Code", "_own", *vector_codes.RESULTS]
    got = out.collect()
    assert want == Counter((g["vec_id"], g["code"], g["error"], g["label_error"], g["codebooks_sha256"]) for g in got if g["label"] != 99)
    assert [(g["code"], g["error"], g["label_error"]) for g in got if g["label"] == 99] == [(None, None, None)]
    assert all((g["own_error"], g["_key"], g["own_Code"], g["_own"]) == (f"e{g['vec_id']}", 7, 8, 9) for g in got)
    assert vector_codes.coded(spark.createDataFrame([], VECTORS)).count() == 0


def test_dictionary_of_wide_columns():
    for column in (np.array([5, -3, 5, 5]), np.array([1 << 40, -(1 << 40), 0, 0])):
        values, places = vector_codes.dictionary(column)
        assert (values[places] == column).all() and list(values) == sorted(set(column.tolist()))


def test_shards_hold_the_mixture(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, f"text {i % 50}" if i % 9 else None, "en", r.choice(["a"] * 6 + ["b"] * 2 + [None])) for i in range(1000)]
    rows += [(None, "é", "en", "a")] * 300 + [(7, "same", "en", "c")] * 303
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "doc_id as _key", "1 as Size", "2 as _at", "3 as _own", "4 as _range")
    got = sharding.interleaved(df).collect()
    assert Counter((g["doc_id"], g["source"], g["size"], g["text_crc32"]) for g in got) == Counter(
        (i, s, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, s in rows
    )
    assert all((g["_key"], g["own_Size"], g["_at"], g["_own"], g["_range"]) == (g["doc_id"], 1, 2, 3, 4) for g in got)
    shards = defaultdict(list)
    for g in got:
        shards[g["shard"]].append(g)
    assert sorted(shards) == list(range(40)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    share = {s: n / len(rows) for s, n in Counter(x[3] for x in rows).items()}
    for of in shards.values():
        assert sorted(g["slot"] for g in of) == list(range(len(of)))
        has = Counter(g["source"] for g in of)
        assert all(abs(has[s] - p * len(of)) <= 2 for s, p in share.items())
    assert {tuple(g) for g in got} == {tuple(g) for g in sharding.interleaved(df.repartition(7)).collect()}
    assert sharding.interleaved(df.limit(0)).count() == 0
    few = sharding.interleaved(df.limit(3)).collect()
    assert len({g["shard"] for g in few}) == 3 and {g["slot"] for g in few} == {0}
    again = sharding.write_shards(spark.createDataFrame(rows, DOCS), str(tmp_path / "shards")).collect()
    assert Counter((g["doc_id"], g["text"], g["lang"], g["source"]) for g in again) == Counter(rows)
    assert all(g["text_crc32"] == zlib.crc32((g["text"] or "").encode()) for g in again)
    place = lambda found: Counter((g["doc_id"], g["text_crc32"], g["shard"], g["slot"]) for g in found)
    assert place(again) == place(got)
