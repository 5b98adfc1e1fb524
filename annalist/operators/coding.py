"""Operators that built-in functions can't express: content-defined chunks, delta coding and line differences.

Each is an Arrow batch function without a shuffle; what a row gives depends on that row only.
"""

from __future__ import annotations

import difflib
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _gear(seed: int = 2024) -> np.ndarray:
    """256 random 32-bit numbers from a fixed seed."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: bytes, target: int = 4096) -> list[int]:
    """Ends of content-defined chunks: where a rolling hash of the last 32 bytes has enough zero bits, more of them before the target size than after; from a quarter to four times the target."""
    bits = round(np.log2(target))
    b = np.frombuffer(data, dtype=np.uint8)
    h = np.zeros(len(b), dtype=np.uint32)
    g = _gear()[b]
    for k in range(min(32, len(b))):  # a byte's influence is shifted out after 32 more
        h[k:] += g[: len(g) - k] << np.uint32(k)
    top = lambda n: np.uint32(((1 << n) - 1) << (32 - n))
    strict, loose = np.flatnonzero((h & top(bits + 2)) == 0) + 1, np.flatnonzero((h & top(bits - 2)) == 0) + 1
    out, at = [], 0
    while at < len(b):
        end = min(at + 4 * target, len(b))
        i = np.searchsorted(strict, at + target // 4)
        j = np.searchsorted(loose, at + target)
        first = int(strict[i]) if i < len(strict) and strict[i] <= at + target else None
        second = int(loose[j]) if j < len(loose) and loose[j] <= end else None
        at = first or second or end
        out.append(at)
    return out


def chunks(docs: DataFrame, key: str, text: str, target: int = 4096) -> DataFrame:
    """Content-defined chunks of each text: key, idx, start, length, hash. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data, at = (t or "").encode(), 0
                for i, end in enumerate(cut_points(data, target)):
                    out.append((k, i, at, end - at, hashlib.sha256(data[at:end]).hexdigest()))
                    at = end
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["key", "idx", "start", "length", "hash"])

    return docs.select(key, text).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, idx long, start long, length long, hash string")


def delta_sizes(versions: DataFrame, key: str, value: str, previous: str, gain: float = 0.9) -> DataFrame:
    """Compressed sizes of each value alone and against the version before it: key, alone, delta, kept ("delta" if at most `gain` of alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alone, delta = [], []
            for v, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = (v or "").encode()
                alone.append(len(zlib.compress(data, 9)))
                if p:
                    c = zlib.compressobj(9, zdict=p.encode()[-32_768:])
                    delta.append(len(c.compress(data) + c.flush()))
                else:
                    delta.append(None)
            kept = ["delta" if d is not None and d <= gain * a else "alone" for a, d in zip(alone, delta)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(alone, pa.int64()), pa.array(delta, pa.int64()), pa.array(kept)], names=["key", "alone", "delta", "kept"])

    return versions.select(key, value, previous).mapInArrow(run, f"key {versions.schema[key].dataType.simpleString()}, alone long, delta long, kept string")


def line_diff(pairs: DataFrame, key: str, before: str, after: str, most: int = 65_536) -> DataFrame:
    """Hunks between two texts: key, kind (add, delete, change), line before, line after, numbers of lines. A text over `most` bytes gives one change of all lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {"insert": "add", "delete": "delete", "replace": "change"}
        for b in batches:
            out = []
            for k, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                a, z = (x or "").splitlines(), (y or "").splitlines()
                if max(len(x or ""), len(y or "")) > most:
                    out.append((k, "change", 0, 0, len(a), len(z)))
                else:
                    out += [(k, names[t], i, m, j - i, n - m) for t, i, j, m, n in difflib.SequenceMatcher(None, a, z, autojunk=False).get_opcodes() if t != "equal"]
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.column(0).type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["key", "kind", "line_before", "line_after", "n_before", "n_after"])

    return pairs.select(key, before, after).mapInArrow(run, f"key {pairs.schema[key].dataType.simpleString()}, kind string, line_before long, line_after long, n_before long, n_after long")
