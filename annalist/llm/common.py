"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Rows of a table at most that broadcast() is used for, after they were counted.
BROADCAST_ROWS = 20_000


def scratch(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables, which the session must name unless all of Spark is on this machine."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if spark.conf.get("spark.master", "").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/annalist-checkpoints"


#: Settings while a table is written: Arrow batches small enough that a worker can hold several, as rows hold whole texts;
#: and shuffle files go as soon as the table stands in their place.
WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """What is run meanwhile has these settings."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/annalist-{uuid.uuid4().hex}"
    with settings(spark, WRITING):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a staged() table that nothing will read again."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; it reads no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal outputs, near ones unrelated outputs."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(29)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(32)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, dtype=U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def as_array(col) -> pa.Array:
    """One string array, nulls as empty strings."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col, "") if col.null_count else col


def slices(batch: pa.RecordBatch, col: str = "text", limit: int = 4_000_000):
    """Parts of a batch of about limit bytes of text each, to bound the memory of what is computed from them."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(at[:-1], at[1:]):
        yield batch.slice(a, b - a)


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lower-case words between white space: offsets by text, and all words as one array."""
    found = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))
    flat, off = found.flatten(), found.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # of texts without a word
        keep = np.concatenate([[0], np.cumsum(~empty)])
        off, flat = keep[off], flat.filter(pa.array(~empty))
    return off, flat


def xxh64(flat: pa.Array) -> np.ndarray:
    """XXH64 (seed 0) of the UTF-8 of each string, all at once; strings of 32 bytes and more one by one."""
    h = np.zeros(len(flat), dtype=U64)
    if not len(flat):
        return h
    off = np.frombuffer(flat.buffers()[1], np.int64 if pa.types.is_large_string(flat.type) else np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    raw = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    at, size = off[:-1] - off[0], np.diff(off)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8).view("<u8")[:, 0]  # from any place on
    p1, p2, p3, p4, p5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, bits: (x << U64(bits)) | (x >> U64(64 - bits))
    h += p5 + size.astype(U64)
    for k in range(3):
        i = np.flatnonzero(size >= 8 * (k + 1))
        h[i] = turned(h[i] ^ turned(eight[at[i] + 8 * k] * p2, 31) * p1, 27) * p1 + p4
    rest = at + (size & ~7)
    i = np.flatnonzero(size & 4)
    h[i] = turned(h[i] ^ (eight[rest[i]] & U64(0xFFFFFFFF)) * p1, 23) * p2 + p3
    rest[i] += 4
    for k in range(3):
        i = np.flatnonzero((size & 3) > k)
        h[i] = turned(h[i] ^ (eight[rest[i]] >> U64(8 * k) & U64(255)) * p5, 11) * p1
    h ^= h >> U64(33)
    h *= p2
    h ^= h >> U64(29)
    h *= p3
    h ^= h >> U64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(flat[i].as_py())
    return h


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by text, and a 64-bit hash of each word."""
    off, flat = words(texts)
    d = pc.dictionary_encode(flat)
    if len(d) == 0:
        return off, np.zeros(0, dtype=U64)
    return off, xxh64(d.dictionary)[d.indices.to_numpy(zero_copy_only=False)]


def shingle_hashes(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by text, and a 64-bit hash of each run of k words; a text of 1 to k - 1 words has one shingle of them all."""
    off, h = word_hashes(texts)
    n = np.diff(off)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_off = np.concatenate([[0], np.cumsum(count)])
    if not out_off[-1]:
        return out_off, np.zeros(0, dtype=U64)
    doc = np.repeat(np.arange(len(n)), count)
    start = off[:-1][doc] + np.arange(out_off[-1]) - out_off[:-1][doc]
    out, wide = np.zeros(len(start), dtype=U64), np.concatenate([h, np.zeros(k, dtype=U64)])
    left = off[1:][doc] - start
    for j in range(k):
        out = out * U64(0x9E3779B97F4A7C15) + np.where(j < left, wide[start + j] | U64(1), U64(0))
    return out_off, mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours: out[i] = min(x[i : i + w]), for the len(x) - w + 1 whole windows."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = -n % w
    top = np.iinfo(x.dtype).max
    y = np.concatenate([x, np.full(pad, top, dtype=x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def components(edges: DataFrame, nodes_a: str = "a", nodes_b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, root), root being the least node of the component.

    Label propagation by alternating large-star and small-star steps, each a grouping on the cluster; edges are kept as
    rows, so that a hub with many neighbours is only ever aggregated (min), never collected. Rounds grow with the
    logarithm of a component's diameter. Empty edges give an empty table.
    """
    e = edges.select(F.col(nodes_a).alias("a"), F.col(nodes_b).alias("b")).where("a <> b")
    e = staged(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(60):
        # large star: link each greater neighbour to the least of the neighbourhood
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: link each node and its lesser neighbours to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        new = staged(small_star)
        sign = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(e)
        e = new
        if sign == last:
            break
        last = sign
    else:
        raise ValueError("the components weren't found after 60 rounds")
    roots = e.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def runs(batches, key: str, rows: int = 20_000):
    """Tables of whole runs of equal keys, from batches in which equal keys stand together; about so many rows each, more only for a longer run."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table[key].to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held, count = rest.to_batches(), len(rest)
    if held:
        yield pa.Table.from_batches(held)
