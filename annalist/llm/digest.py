"""Similarity digests of whole texts: improbable byte windows, chosen by the rarity of their entropy, in chained Bloom filters."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, powers, sliding_min

WINDOW, NEIGHBOURS, POPULAR, BUCKETS = 64, 64, 16, 1000
BITS, CAPACITY, HASHES = 2048, 160, 5
#: Buckets of entropy below this are of runs and hardly vary; they are never features.
LEAST = 150
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_GAIN = np.array([0.0, *(c * np.log2(c) for c in range(1, WINDOW + 1))])
_GAIN = np.rint(_GAIN * 65536).astype(np.int64)
_STEP = np.diff(_GAIN).astype(np.int64)
_TOP = 1 << 11


def _entropy(b: np.ndarray) -> np.ndarray:
    """Entropy bucket (0 .. BUCKETS) of each 64-byte window of b, in integers, from the counts that change as it slides."""
    n = len(b)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int64)
    into, out = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    for k in range(1, WINDOW):
        same = (b[k:] == b[:-k]).view(np.uint8)
        into[k:] += same
        out[:-k] += same
    # the first windows see fewer than 63 bytes before them, which is what their counts say
    gained = np.cumsum(_STEP[into])
    lost = np.concatenate([[0], np.cumsum(_STEP[out])])
    total = gained[WINDOW - 1 :] - lost[: n - WINDOW + 1]
    return np.clip((6 * WINDOW * 65536 - total) * BUCKETS // (6 * WINDOW * 65536), 0, BUCKETS)


def _packed(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts whose bytes come to about CHUNK; a longer text is a run of its own."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def entropy_histogram(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many windows of all texts have each entropy bucket: one sum over the corpus, of BUCKETS + 1 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(0).cast(pa.binary())]
            for a, z in _packed(texts):
                sizes = np.array([len(t) for t in texts[a:z]])
                ent = _entropy(np.frombuffer(b"".join(texts[a:z]), dtype=np.uint8))
                total += np.bincount(ent[_starts(sizes)[2]], minlength=BUCKETS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(total)], names=["bucket", "n"])

    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def rarity(histogram: np.ndarray) -> np.ndarray:
    """Rank of each bucket, the rarest first; those below LEAST and those that don't occur come last."""
    order = np.lexsort((np.arange(len(histogram)), np.where(histogram > 0, histogram, np.iinfo(np.int64).max)))
    rank = np.empty(len(histogram), dtype=np.int64)
    rank[order] = np.arange(len(histogram))
    rank[:LEAST] = _TOP - 1
    return rank


def _starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: offsets, windows in each, and where these windows start."""
    off = np.concatenate([[0], np.cumsum(sizes)])
    count = np.maximum(sizes - WINDOW + 1, 0)
    at = np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    return off, count, at


def digests(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The Bloom filters of each text, as rows of BITS / 8 bytes."""
    out: list[np.ndarray] = []
    for a, z in _packed(texts):
        out += _digests(texts[a:z], rank)
    return out


def _digests(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    b = np.frombuffer(b"".join(texts), dtype=np.uint8)
    off, count, at = _starts(sizes)
    doc = np.repeat(np.arange(len(texts)), count)
    picked = np.zeros(0, dtype=np.int64)
    if len(at):
        # ranks of the windows of all texts, end to end; neighbourhoods that cross from one text to the next don't vote
        order = rank[_entropy(b)[at]]
        key = order * (1 << 40) + np.arange(len(at))
        best = sliding_min(key, NEIGHBOURS)
        votes = best[doc[: len(best)] == doc[NEIGHBOURS - 1 :]] if len(best) else best
        score = np.bincount(votes & ((1 << 40) - 1), minlength=len(at))
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        few = (count[doc] < NEIGHBOURS) & ((np.arange(len(at)) - first[doc]) % 8 == 0)
        picked = np.flatnonzero((score >= POPULAR) & (order < _TOP - 1) | few)
    where, of = at[picked], doc[picked]
    prefix = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(b.astype(U64) * powers(_BASE, len(b)) + U64(0), dtype=U64)])
    value = (prefix[where + WINDOW] - prefix[where]) * powers(pow(_BASE, -1, 1 << 64), len(b) + 1)[where]
    tiny = np.flatnonzero((sizes > 0) & (sizes < WINDOW))  # one feature: the whole text
    value = np.concatenate([value, np.array([int.from_bytes(hashlib.md5(texts[i]).digest()[:8], "little") for i in tiny], dtype=U64)])
    of, where = np.concatenate([of, tiny]), np.concatenate([where, off[:-1][tiny]])
    value = mix(value)
    by = np.lexsort((where, value, of))
    fresh = np.ones(len(by), dtype=bool)
    fresh[1:] = (value[by][1:] != value[by][:-1]) | (of[by][1:] != of[by][:-1])
    keep = np.sort(by[fresh])
    keep = keep[np.lexsort((where[keep], of[keep]))]
    value, of = value[keep], of[keep]
    n = np.bincount(of, minlength=len(texts))
    filters = -(-n // CAPACITY)
    base = np.concatenate([[0], np.cumsum(filters)])
    nth = np.arange(len(of)) - np.concatenate([[0], np.cumsum(n)])[of]
    bits = np.zeros((base[-1], BITS), dtype=bool)
    for k in range(HASHES):
        bits[base[of] + nth // CAPACITY, ((value >> U64(11 * k)) & U64(BITS - 1)).astype(np.int64)] = True
    rows = np.packbits(bits, axis=1)
    return [rows[base[i] : base[i + 1]] for i in range(len(texts))]


def fingerprint(filters: np.ndarray) -> str:
    return f"{len(filters)}:{base64.b64encode(filters.tobytes()).decode()}"


def from_fingerprint(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text.split(":", 1)[1]), dtype=np.uint8).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Bit overlap beyond what chance gives, from 0 to 1: each filter of the shorter digest against its best match in the other, weighted by its bits."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    x, y = a.view(U64), b.view(U64)
    ones_a, ones_b = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    best = np.zeros(len(x))
    for i in range(len(x)):  # rows of one digest, so that memory stays in proportion to the other
        both = np.bitwise_count(x[i] & y).sum(axis=1, dtype=np.int64)
        most = np.minimum(ones_a[i], ones_b)
        chance = np.minimum(ones_a[i] * ones_b / BITS, most)
        best[i] = max(0.0, ((both - chance) / np.where(most > chance, most - chance, 1)).max())
    return float(np.clip((best * ones_a).sum() / ones_a.sum(), 0, 1))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Rows (part, extra, doc_id, text) laid out so that each row's next one by descending id follows it.

    Ranges of ids, each one sorted part of the result; the first row of the range that follows is added to a part's end
    (extra = 1), and the first of all after the last. So whole texts move once. Null ids come last, rows of one id are in
    order of their texts.
    """
    spark = docs.sparkSession
    least = -(2**63)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("_at"))
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)
    cuts = rows.agg(F.percentile_approx("_at", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    cuts = sorted({c for c in cuts if c is not None})
    # ranges count from the largest ids on; part p holds the ids that p of the cuts are at or above
    below = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c >= F.col("_at"))) if cuts else F.lit(0)
    rows = rows.withColumn("part", below)
    heads = sorted((r["part"], r["m"]) for r in rows.groupBy("part").agg(F.max("_at").alias("m")).collect())
    before = {heads[(i + 1) % len(heads)][1]: heads[i][0] for i in range(len(heads))}
    extra = rows.where(F.col("_at").isin(list(before))) if before else rows.limit(0)
    to = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_at")] if before else F.lit(0)
    both = rows.withColumn("extra", F.lit(0)).union(extra.withColumn("part", to).withColumn("extra", F.lit(1)))
    return both.repartitionByRange(max(1, len(heads)), "part").sortWithinPartitions("part", "extra", F.desc("_at"), "text").select("part", "extra", "doc_id", "text")


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", histogram: np.ndarray | None = None) -> DataFrame:
    """(doc_id, fingerprint) of every whole text. Null texts are empty: no filter, "0:". Texts of under 64 bytes have one feature. Rows are independent; equal texts have equal fingerprints."""
    rank = rarity(entropy_histogram(docs, text_col) if histogram is None else histogram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode() for t in pc.fill_null(b.column(1), "").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x) for x in digests(texts, rank)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's digest against those of its edited text (its last half replaced by the start of the next document's text) and of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The rank of windows
    comes from the entropies of all texts. Null texts are empty (likeness 1 between two empty ones, 0 to others); a
    single document is its own next one; repeated ids follow each other in order of their texts.
    """
    rank = rarity(entropy_histogram(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which waits for the next one
        for b in batches:
            for s in range(0, b.num_rows, 256):
                c = b.slice(s, 256)
                rows = list(zip(c.column("part").to_pylist(), c.column("extra").to_pylist(), c.column("doc_id").to_pylist(), c.column("text").to_pylist()))
                own = digests([r[3].encode() for r in rows], rank)
                rows = [(*r, d) for r, d in zip(rows, own)]
                pairs = [(x, y) for x, y in zip([held, *rows[:-1]] if held else rows[:-1], rows if held else rows[1:]) if not x[1] and x[0] == y[0]]
                held = rows[-1]
                edited = [(t := x[3])[: len(t) - (h := len(t) // 2)] + y[3][:h] for x, y in pairs]
                raw = [t.encode() for t in edited]
                prints = digests(raw, rank)
                out = [(x[2], len(x[3]), hashlib.sha256(t).hexdigest(), fingerprint(x[4]), fingerprint(d), likeness(x[4], d), likeness(x[4], y[4])) for (x, y), t, d in zip(pairs, raw, prints)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (b.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs, id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
