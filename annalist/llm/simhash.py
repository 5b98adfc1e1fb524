"""SimHash near-duplicates: fingerprints of word shingles, linked through indices of a Golay code.

A fingerprint's 64 bits are three segments of 21, 21 and 22 bits, each read as a word of the binary Golay code of length 23
(missing bits are zero). The code is perfect: every word lies within three bits of exactly one codeword. A segment's keys
are the indices of the codewords that itself and its 23 neighbours at one bit decode to, which are one or six. Segments at
two bits or fewer have a word between them at one bit from both, so they share a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_array, components, dropped, slices, staged

#: Words of a shingle, the hash's seed, bits that linked fingerprints differ by at most, white space.
SHINGLE, SEED, NEAR, SPACE = 4, 42, 4, (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the code, its length, the bits of an index.
GENERATOR, LENGTH, INDEX = 0b110001110101, 23, 12
#: First bit and bits of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints of a bucket that are compared in one piece; larger buckets are split into pairs of blocks.
BLOCK = 1024


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes with A-Z in lower case, and the offsets by text."""
    texts = texts.cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data], off - off[0]


def word_bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Words by text with one space between them: offsets of words by text, starts and ends of words, and the bytes."""
    data, off = lowered(texts)
    is_word = np.ones(256, dtype=bool)
    is_word[list(SPACE)] = False
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    first[heads] = inside[heads]  # a text's first byte starts a word whatever stands before it
    at = np.flatnonzero(first)
    number = np.cumsum(first, dtype=np.int32)[inside] - 1
    length = np.bincount(number, minlength=len(at)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(length + 1)])[:-1].astype(np.int64)
    out = np.full(int(length.sum()) + len(at), 0x20, dtype=np.uint8)
    out[np.arange(len(number)) + number] = data[inside]
    return np.searchsorted(at, off), starts, starts + length, out.tobytes()


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is set where over half of its shingles' hashes have it; zero without words."""
    off, starts, ends, data = word_bounds(texts)
    n = np.diff(off)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    out = np.zeros(len(texts), dtype=np.uint64)
    total = int(count.sum())
    if not total:
        return out
    doc = np.repeat(np.arange(len(n)), count)
    at = np.concatenate([[0], np.cumsum(count)])
    first = off[:-1][doc] + np.arange(total) - at[:-1][doc]
    last = np.minimum(first + SHINGLE, off[1:][doc]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist())), dtype=np.uint64, count=total)
    some = np.flatnonzero(count)
    ones = np.zeros((len(some), 64), dtype=np.int64)
    for k in range(0, total, 1 << 18):  # a bounded part of the bits at a time
        part = np.unpackbits(h[k : k + (1 << 18)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = doc[k : k + (1 << 18)]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
        ones[np.searchsorted(some, of[cut])] += np.add.reduceat(part, cut, axis=0, dtype=np.int64)
    bits = 2 * ones > count[some][:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of all 23-bit words' upper parts, and the error word of up to three bits for each of the 2,048 syndromes."""
    top = np.arange(1 << INDEX, dtype=np.int64) << (LENGTH - INDEX)
    for b in range(LENGTH - 1, LENGTH - INDEX - 1, -1):
        top ^= ((top >> b) & 1) * (GENERATOR << (b - (LENGTH - INDEX)))
    bits = np.arange(LENGTH)
    errors = [0] + [sum(1 << b for b in some) for k in (1, 2, 3) for some in _choose(bits, k)]
    errors = np.array(errors, dtype=np.int64)
    of = np.zeros(1 << (LENGTH - INDEX), dtype=np.int64)
    of[_syndrome(errors, top)] = errors
    return top, of


def _choose(bits, k: int):
    from itertools import combinations

    return combinations(bits.tolist(), k)


def _syndrome(x: np.ndarray, top: np.ndarray) -> np.ndarray:
    return top[x >> (LENGTH - INDEX)] ^ (x & ((1 << (LENGTH - INDEX)) - 1))


def decoded(x: np.ndarray) -> np.ndarray:
    """Index (upper 12 bits) of the one codeword within three bits of each 23-bit word."""
    top, of = _tables()
    return (x ^ of[_syndrome(x, top)]) >> (LENGTH - INDEX)


def indices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices of the codewords that each word and its neighbours at one bit decode to: word numbers, indices."""
    flips = np.concatenate([[0], 1 << np.arange(LENGTH)])
    all_ = np.sort(decoded(x[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(all_.shape, dtype=bool)
    new[:, 1:] = all_[:, 1:] != all_[:, :-1]
    return np.nonzero(new)[0], all_[new]


def _product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each value of a word in a, joined with each of the same word in b: word numbers, a << bits | b."""
    many = np.bincount(b[0], minlength=n)
    start = np.concatenate([[0], np.cumsum(many)])[:-1]
    times = many[a[0]]
    of = np.repeat(np.arange(len(times)), times)
    at = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + start[a[0]][of]
    return a[0][of], a[1][of] << bits | b[1][at]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints, of which any two with at most four differing bits share one: fingerprint numbers, keys.

    Four errors in three segments: either some segment has none, and another at most two (its whole value, with an index of
    the other: six kinds of key of 33 or 34 bits), or all have one or two (an index of each: one kind, 36 bits).
    """
    n = len(fp)
    parts = [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    near = [indices(p) for p in parts]
    whole = [(np.arange(n), p) for p in parts]
    found = [_product(_product(near[0], near[1], INDEX, n), near[2], INDEX, n)]
    for i in range(3):
        for j in range(3):
            if i != j:
                w, k = _product(whole[i], near[j], INDEX, n)
                found.append((w, k | (3 * i + j + 1) << 40))
    return np.concatenate([w for w, _ in found]), np.concatenate([k for _, k in found])


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links a - b connect something that those before them don't."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    keep = np.zeros(len(a), dtype=bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            root[x], keep[i] = y, True
    return keep


def linked(x: np.ndarray, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what fingerprints of x (with those of y, if given) are near each other: a spanning forest of the near pairs."""
    found_a, found_b = [], []
    for i in range(0, len(x), 256):
        part = x[i : i + 256]
        other = y if y is not None else x[i:]
        r, c = np.nonzero(np.bitwise_count(part[:, None] ^ other[None, :]) <= NEAR)
        if y is None:
            r, c = r[c > r], c[c > r]
        found_a.append(part[r])
        found_b.append(other[c])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    keep = _forest(a, b)
    return a[keep], b[keep]


KEYED = "key long, fp long"
COMPARED = "a long, b long, key long, block int, fps binary"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for i in range(0, len(fps), 2048):
            part = fps[i : i + 2048]
            of, key = keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[of].view(np.int64))], ["key", "fp"])


def _rows(a: np.ndarray, b: np.ndarray, key=(), block=(), fps=()) -> pa.RecordBatch:
    n, m = len(a), len(key)
    cols = [pa.concat_arrays([pa.array(v.view(np.int64)), pa.nulls(m, pa.int64())]) for v in (a, b)]
    cols += [pa.concat_arrays([pa.nulls(n, t), pa.array(v, t)]) for v, t in ((key, pa.int64()), (block, pa.int32()), (fps, pa.binary()))]
    return pa.RecordBatch.from_arrays(cols, ["a", "b", "key", "block", "fps"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the runs of equal keys; a run beyond BLOCK comes out in blocks, never held whole.

    What is left of a run at a batch's end is carried on, at most a block of it.
    """
    key, fp, number = np.zeros(0, np.int64), np.zeros(0, np.uint64), 0

    def done(key: np.ndarray, fp: np.ndarray, number: int):
        """Short runs at once, by distance of the rows; number: blocks that the first run already came out in."""
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(cut, len(key)))
        blocks = ([], [], [])
        if number or size.max() > BLOCK:
            for c, s, k in zip(cut.tolist(), size.tolist(), range(len(cut))):
                first = number if k == 0 else 0
                if first or s > BLOCK:
                    for j in range(0, s, BLOCK):
                        blocks[0].append(int(key[c]))
                        blocks[1].append(first + j // BLOCK)
                        blocks[2].append(fp[c + j : min(c + j + BLOCK, c + s)].tobytes())
                    size[k] = 0
        a, b = [], []
        for c, s in zip(cut[size > 64].tolist(), size[size > 64].tolist()):
            x, y = linked(fp[c : c + s])
            a.append(x)
            b.append(y)
        left = np.repeat(np.where(size > 64, 0, size), np.diff(np.append(cut, len(key)))) - (np.arange(len(key)) - np.repeat(cut, np.diff(np.append(cut, len(key)))))
        for d in range(1, int(min(64, size.max(initial=0)))):
            at = np.flatnonzero(left > d)
            near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= NEAR]
            a.append(fp[near])
            b.append(fp[near + d])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.zeros((2, 0), np.uint64)
        return _rows(pairs[0], pairs[1], *blocks)

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate([key, batch.column("key").to_numpy()])
        fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
        begins = np.flatnonzero(key != key[-1])
        cut = int(begins[-1]) + 1 if len(begins) else 0
        if cut:
            yield done(key[:cut], fp[:cut], number)
            key, fp, number = key[cut:], fp[cut:], 0
        whole = len(fp) // BLOCK - (len(fp) % BLOCK == 0 and number == 0)  # a run of one block only isn't split
        if whole > 0 and (number or len(fp) > BLOCK):
            none = np.zeros(0, np.uint64)
            yield _rows(none, none, [int(key[0])] * whole, list(range(number, number + whole)), [fp[j * BLOCK : (j + 1) * BLOCK].tobytes() for j in range(whole)])
            key, fp, number = key[whole * BLOCK :], fp[whole * BLOCK :], number + whole
    if len(key):
        yield done(key, fp, number)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x, y in zip(batch.column("fps").to_pylist(), batch.column("other").to_pylist()):
            a, b = linked(np.frombuffer(x, np.uint64), None if y is None else np.frombuffer(y, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def fingerprinted(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of every row, from its whole text; a null text counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = fingerprints(as_array(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(each, f"doc_id {kind}, fp long")


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (fp) at four or fewer differing bits; not every near pair is a row.

    Fingerprints meet in buckets of equal keys. A bucket of up to 1,024 is compared in one piece; a larger one leaves its task in
    blocks, and pairs of blocks are compared in tasks of their own, each giving a spanning forest of its near pairs.
    """
    dealt = fps.select("fp").mapInArrow(_keyed, KEYED).repartition("key").sortWithinPartitions("key", "fp")
    found = staged(dealt.mapInArrow(_compared, COMPARED))
    blocks = found.where("fps is not null").select("key", "block", "fps")
    other = blocks.select("key", F.col("block").alias("_b"), F.col("fps").alias("_o"))
    met = blocks.join(other, "key").where("block <= _b").select("fps", F.when(F.col("block") < F.col("_b"), F.col("_o")).alias("other"))
    crossed = met.repartition(F.xxhash64("fps", "other")).mapInArrow(_pairs, "a long, b long")
    return found.where("a is not null").select("a", "b").union(crossed).distinct()


def near_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprint and component of every row: doc_id, fingerprint (16 lowercase hex digits), component_id.

    component_id is the least id of what the row reaches by links, itself included. Every row is kept: null texts count as
    empty, texts without a word have the fingerprint zero and are linked like others; a null id is no least id, so a component
    of null ids alone has a null component_id. Rows with equal ids stay. An empty table gives an empty table.
    """
    rows = staged(fingerprinted(docs, text, id_col))
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(distinct)).withColumnRenamed("node", "fp")
    by_fp = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = by_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    of = staged(by_fp.join(by_root, "root").select("fp", "component_id"))
    dropped(distinct)
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
