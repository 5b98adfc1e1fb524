"""SimHash: fingerprints and components against plain versions, and what the code's keys promise."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from annalist.llm import simhash

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    words = [w.translate(lower) for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode()) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """The least id that each (id, fingerprint) row reaches, by comparing all pairs."""
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= 4:
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(fps):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return [least.get(top(i)) for i in range(len(fps))]


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_documents(df).collect()), key=repr)
    fps = [(k, plain_fingerprint(t)) for k, t in rows]
    wanted = sorted(((k, f"{f:016x}", c) for (k, f), c in zip(fps, plain_components(fps))), key=repr)
    assert got == wanted
    return wanted


def test_same_as_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "Bdk" for b in "aeiou" for c in "lmnr"]
    rows = []
    for g in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(20, 400))
        for _ in range(rng.choice([1, 1, 3, 12])):
            edited = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append((rng.randrange(10_000), rng.choice([" ", "  ", "\n"]).join(edited)))
    wanted = check(spark, rows)
    assert len({c for *_, c in wanted}) < len(rows) - 20


def test_edges(spark):
    assert simhash.near_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    check(spark, [(3, None), (7, ""), (9, " \t\x0b\x0c "), (None, "null id"), (1, "a"), (1, "a"), (2, "A b"), (4, "\x1c É é"), (5, long), (6, long + " end"), (8, "x" * 300_000)])
    df = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four five")], SCHEMA).selectExpr("*", "'z' as fp", "1 as key", "'q' as least", "5 as root", "0 as a")
    assert [r.component_id for r in simhash.near_documents(df).collect()] == [1, 1]


def test_fingerprints_of_sliced_texts():
    texts = ["Zero", "", "One two\tthree four FIVE", None and "", " lead", "trail ", "a b c d e f g"]
    texts = [t or "" for t in texts]
    whole = simhash.fingerprints(pa.array(texts))
    assert whole.tolist() == [plain_fingerprint(t) for t in texts]
    assert simhash.fingerprints(pa.array(texts).slice(2, 3)).tolist() == whole[2:5].tolist()


def test_code_is_perfect():
    x = np.arange(1 << 23)
    index = simhash.decoded(x)
    assert np.bincount(index, minlength=4096).tolist() == [2048] * 4096
    top, of = simhash._tables()
    word = x ^ of[simhash._syndrome(x, top)]
    assert len(np.unique(word)) == 4096 and np.bitwise_count(x ^ word).max() == 3


def test_four_errors_share_a_key():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    other = fp.copy()
    for i in range(len(fp)):
        for b in rng.choice(64, 4, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    both = []
    for side in (fp, other):
        of, key = simhash.keys(side)
        both.append(set(zip(of.tolist(), key.tolist())))
    assert {i for i, _ in both[0] & both[1]} == set(range(len(fp)))


def roots(links, nodes):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[top(a)] = top(b)
    groups = {}
    for n in nodes:
        groups.setdefault(top(n), set()).add(n)
    return sorted(map(sorted, groups.values()))


def test_large_buckets_come_out_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(1)
    for size in (15, 16, 17, 32, 33, 100, 130):
        centre = rng.integers(0, 1 << 64, 3, dtype=np.uint64)
        fps = np.unique(np.concatenate([centre[k % 3 : k % 3 + 1] ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for k in range(size)]))
        lone = rng.integers(0, 1 << 64, 5, dtype=np.uint64)
        key = np.concatenate([[1, 1], np.full(len(fps), 2), [3, 4, 4]]).astype(np.int64)
        fp = np.concatenate([lone[:2], fps, lone[2:]])
        batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 7]), pa.array(fp[i : i + 7].view(np.int64))], ["key", "fp"]) for i in range(0, len(key), 7)]
        links, blocks = [], {}
        for out in simhash._compared(iter(batches)):
            for r in out.to_pylist():
                if r["fps"] is None:
                    links.append((r["a"] % 2**64, r["b"] % 2**64))
                else:
                    blocks[r["key"], r["block"]] = np.frombuffer(r["fps"], np.uint64)
        assert not blocks or all(len(b) <= 16 for b in blocks.values()) and sorted(np.concatenate([b for (k, _), b in blocks.items() if k == 2]).tolist()) == fps.tolist()
        assert bool(blocks) == (len(fps) > 16)
        for (k, i), x in blocks.items():
            for (m, j), y in blocks.items():
                if k == m and i <= j:
                    links += list(zip(*[v.tolist() for v in simhash.linked(x, None if i == j else y)]))
        near = [(a, b) for a in fps.tolist() for b in fps.tolist() if (a ^ b).bit_count() <= 4]
        assert all((a ^ b).bit_count() <= 4 for a, b in links)
        assert roots(links, fp.tolist()) == roots(near, fp.tolist())
