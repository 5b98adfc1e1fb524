"""Content-addressed storage: blocks and their references, differences of block maps, packs, and delta chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FRAME, FILE_BLOCK = 16_384, 65_536


def blocks(docs: DataFrame, key: str, text: str, width: int = FRAME) -> DataFrame:
    """Fixed-width byte blocks of each text: key, idx, hash (SHA-256), length. An empty text has one empty block, a null none."""
    raw = F.encode(F.col(text), "UTF-8")
    last = F.expr(f"greatest(octet_length({text}) - 1, 0) div {width}")
    cut = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), text, F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("idx"))
    cut = cut.withColumn("_b", F.substring(raw, (F.col("idx") * width + 1).cast("int"), F.lit(width)))
    return cut.select("key", "idx", F.sha2("_b", 256).alias("hash"), F.octet_length("_b").cast("long").alias("length"))


def frame_documents(docs: DataFrame, key: str, text: str, width: int = FRAME) -> DataFrame:
    """Distinct blocks with the number of their occurrences: h, refs, raw_size. Counts are partial sums before the shuffle, so a block shared by many texts costs a row a task."""
    return blocks(docs, key, text, width).groupBy(F.col("hash").alias("h")).agg(F.count("*").alias("refs"), F.max("length").alias("raw_size"))


def statistics(frames: DataFrame) -> DataFrame:
    """One row: blocks, their bytes once and as often as referenced, blocks without references, and the ratio of these bytes."""
    out = frames.agg(F.count("*").alias("frames"), F.sum("raw_size").cast("long").alias("stored_bytes"), F.sum(F.col("raw_size") * F.col("refs")).cast("long").alias("captured_bytes"), F.count_if(F.col("refs") == 0).alias("orphans"))
    return out.withColumn("ratio", F.round(F.when(F.col("stored_bytes") > 0, F.col("captured_bytes") / F.col("stored_bytes")).otherwise(1.0), 6))


def block_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """By file (key): positions, positions whose block differs, blocks new to the file, blocks it dropped, and whether it looks shifted.

    Shifted: both versions have 16 blocks or more and over 0.3 of the positions differ.
    """
    a, b = (x.select("key", "idx", F.col("hash").alias(n)) for x, n in ((before, "_a"), (after, "_b")))
    changed = a.join(b, ["key", "idx"], "full_outer").groupBy("key").agg(F.count("*").alias("positions"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"), F.count("_a").alias("n_before"), F.count("_b").alias("n_after"))
    only = lambda x, y, n: x.select("key", "hash").distinct().join(y.select("key", "hash").distinct(), ["key", "hash"], "left_anti").groupBy("key").agg(F.count("*").alias(n))
    out = changed.join(only(after, before, "new"), "key", "left").join(only(before, after, "dropped"), "key", "left").na.fill(0, ["new", "dropped"])
    shifted = (F.least("n_before", "n_after") >= 16) & (F.col("changed") / F.col("positions") > 0.3)
    return out.select("key", "positions", "changed", "new", "dropped", shifted.alias("shifted"))


def missing(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Blocks to upload: those of a map that the store hasn't, once each."""
    return wanted.select("hash", "length").distinct().join(stored.select("hash"), "hash", "left_anti")


def pack_offsets(frames: DataFrame, pack: str, order: str, size: str) -> DataFrame:
    """Where each frame starts in its pack: the sum of the sizes before it."""
    w = Window.partitionBy(pack).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return frames.select(pack, order, size, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long").alias("pack_offset"))


def pack_liveness(members: DataFrame, dead: DataFrame) -> DataFrame:
    """By pack: frames, and whether all of them are among the dead ones, so that the pack may go."""
    out = members.join(dead.select("hash", F.lit(True).alias("_dead")), "hash", "left")
    return out.groupBy("pack").agg(F.count("*").alias("frames"), F.bool_and(F.coalesce("_dead", F.lit(False))).alias("removable"))


def record_references(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The frame index after a write: references add up, the first creation stays. Both: hash, refs, created."""
    return stored.unionByName(new).groupBy("hash").agg(F.greatest(F.sum("refs"), F.lit(0)).cast("long").alias("refs"), F.min("created").alias("created"))


def shard_path(digest):
    """ab/cd/abcd... of a digest column."""
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def frames_per_dictionary(frames: DataFrame) -> DataFrame:
    """Referenced frames by the dictionary they were compressed against."""
    return frames.where("dictionary is not null and refs > 0").groupBy("dictionary").agg(F.count("*").alias("frames"))


def trim(ops: DataFrame, through: int) -> DataFrame:
    """The journal without what was sealed up to a sequence."""
    return ops.where(F.col("sequence") > through)


def forget(index: DataFrame, hashes: DataFrame, key: str = "hash") -> DataFrame:
    """An index without the listed rows."""
    return index.join(hashes.select(key), key, "left_anti")


def cut(files: DataFrame, key: str, body: str, width: int) -> DataFrame:
    """Blocks of a width in bytes: key, position, block (binary). Null and empty bodies have one empty block."""
    b = F.coalesce(F.encode(F.col(body).cast("string"), "utf-8"), F.encode(F.lit(""), "utf-8"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.length(b) - 1, F.lit(0)) / width).cast("long")))
    return files.select(key, b.alias("_b"), at.alias("position")).select(key, "position", F.substring("_b", (F.col("position") * width + 1).cast("int"), F.lit(width)).alias("block"))


def reassemble(blocks: DataFrame, key: str) -> DataFrame:
    """Files from their blocks in order of position: key, body (binary), pieces. A file must fit one row, as it does in the source."""
    parts = F.array_sort(F.collect_list(F.struct("position", "block")))
    out = blocks.groupBy(key).agg(parts.alias("_p"), F.count("*").alias("pieces"))
    return out.select(key, F.unhex(F.array_join(F.transform("_p", lambda p: F.hex(p["block"])), "")).alias("body"), "pieces")
