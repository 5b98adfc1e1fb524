"""A store of objects as files, and the index that can be made again from nothing but these files.

Packs hold frames, a JSON line each; commits and segments are JSON too. Addresses are SHA-256 digests of what an object holds, so a
rebuild computes them again and tells what was cut or changed. Files are listed by Spark's binary reader, with the pack or the second in the path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import walks
from ..operators.ranges import numbered
from ..plans.staging import staged

ENTRY = "hash string, raw long, body string, parent string, dictionary string"
COMMIT = "id string, content string, parent string, merge string"
CONTENT = "segment long, microtime long"
MANIFEST = "frames array<string>"


def addressed(commits: DataFrame) -> DataFrame:
    """Commits (segment, microtime) with their content as JSON and their address, its digest: content, id.

    The links to parents stand beside the content, so the addresses of a long history don't have to be made one after the other.
    """
    return commits.withColumn("content", F.to_json(F.struct("segment", "microtime"))).withColumn("id", F.sha2("content", 256))


def write_packs(frames: DataFrame, folder: str) -> None:
    """Write frames (pack, hash, body: binary, parent, dictionary), a file a pack, which must be small enough for a task to read whole."""
    line = F.to_json(F.struct("hash", F.length("body").cast("long").alias("raw"), F.base64("body").alias("body"), "parent", "dictionary"))
    frames.select("pack", "hash", line.alias("value")).repartition("pack").sortWithinPartitions("pack", "hash").select("pack", "value").write.partitionBy("pack").text(f"{folder}/packs")


def write_manifests(segments: DataFrame, folder: str, level: int = 0) -> None:
    """Write segments (second, frames: their addresses), a file a second."""
    rows = segments.select(F.lit(level).alias("level"), "second", F.to_json(F.struct("frames")).alias("value"))
    rows.repartition("second").sortWithinPartitions("second").write.partitionBy("level", "second").text(f"{folder}/segments")


def write_commits(commits: DataFrame, folder: str, per_file: int = 86_400_000_000) -> None:
    """Write commits (id, content, parent, merge, microtime), a file a day."""
    rows = commits.select(F.expr(f"microtime div {per_file}").alias("day"), F.to_json(F.struct("id", "content", "parent", "merge")).alias("value"))
    rows.repartition("day").sortWithinPartitions("day").write.partitionBy("day").text(f"{folder}/commits")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Objects under a folder: path, length, modified. Their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def segment_keys(spark: SparkSession, folder: str, start: int, end: int, level: int = 0) -> DataFrame:
    """(path, second) of the segments of a level whose second lies in a range, both ends included. A path of another shape is no segment."""
    second = F.regexp_extract("path", rf"/level={level}/second=(\d+)/[^/]*$", 1)
    return listing(spark, f"{folder}/segments").select("path", F.when(second != "", second.cast("long")).alias("second")).where(F.col("second").between(start, end))


def _lines(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Non-empty lines of all files of a kind: path, key (the folder's name without its column), line, offset (bytes before it), text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/{name}")
    rows = files.select("path", F.regexp_extract("path", r"=([^/=]*)/[^/]*$", 1).alias("key"), F.posexplode(F.split(F.decode("content", "utf-8"), "\n")).alias("line", "text"))
    before = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long")).where("text <> ''")


@dataclass
class Rebuilt:
    """frames: hash, pack, offset, length, raw, parent, dictionary, refs. commits: id, number, parent, merge, segment, microtime. problems: kind, key, code."""

    frames: DataFrame
    commits: DataFrame
    problems: DataFrame


def reindex(spark: SparkSession, folder: str, refs: DataFrame) -> Rebuilt:
    """Make the index again from the files in a folder and refs (name, tip: a commit's address).

    A line that can't be read, or whose address isn't that of its content, is a problem and not indexed; of copies of a frame the one in the
    least pack is. References come from the manifests of the segments that reachable commits name, each segment once and each of its
    frames once; what is missing on the way is a problem.
    """
    entries = staged(_lines(spark, folder, "packs").select("key", "line", "offset", F.octet_length("text").cast("long").alias("length"), F.from_json("text", ENTRY).alias("e")))
    body = F.try_to_binary("e.body", F.lit("base64"))
    state = F.when(F.col("e.hash").isNull() | body.isNull(), "entry.unreadable").when(F.sha2(body, 256) != F.col("e.hash"), "frame.hash_mismatch")
    checked = staged(entries.select("key", "line", "offset", "length", "e.hash", "e.raw", "e.parent", "e.dictionary", state.alias("code")))
    place = F.struct(F.col("key").alias("pack"), "offset", "length", "raw", "parent", "dictionary")
    frames = checked.where("code is null").groupBy("hash").agg(F.min_by(place, F.struct("key", "offset")).alias("x")).select("hash", "x.*")
    named = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.col("code"))
    problems = checked.where("code is not null").select(named("pack", F.concat_ws(":", "key", "line")).alias("p"))

    lines = _lines(spark, folder, "commits").select("key", "line", F.from_json("text", COMMIT).alias("c")).select("key", "line", "c.*", F.from_json("c.content", CONTENT).alias("x"))
    wrong = F.when(F.col("id").isNull() | F.col("content").isNull() | F.col("x.microtime").isNull(), "commit.unreadable").when(F.sha2("content", 256) != F.col("id"), "commit.hash_mismatch")
    read = staged(lines.withColumn("code", wrong))
    problems = problems.union(read.where("code is not null").select(named("commit", F.concat_ws(":", "key", "line"))))
    commits = staged(numbered(read.where("code is null").groupBy("id").agg(F.first("x").alias("x"), F.max("parent").alias("parent"), F.max("merge").alias("merge")).select("id", "parent", "merge", "x.*"), "microtime", "id"))

    # parents are addresses; walks want numbers, which lie close together where commits do
    of = commits.select(F.col("id").alias("_id"), F.col("number").alias("_to"))
    links = commits.select("number", F.explode(F.array_compact(F.array("parent", "merge"))).alias("_id")).join(of, "_id", "left")
    tips = refs.join(of, refs["tip"] == of["_id"], "left")
    edges = links.where("_to is not null").select(F.col("number").alias("child"), F.col("_to").alias("parent"))
    seeds = tips.where("_to is not null").select(F.lit(0).alias("label"), F.col("_to").alias("node"))
    at = staged(walks.reached(walks.levels(edges), seeds).select(F.col("node").alias("number")))
    lost = links.where("_to is null").join(at, "number", "left_semi").select("_id").union(tips.where("_to is null").select("tip")).distinct()
    problems = problems.union(lost.withColumn("code", F.lit("commit.missing")).select(named("commit", F.col("_id"))))

    wanted = commits.join(at, "number", "left_semi").where("segment is not null").select(F.col("segment").alias("second")).distinct()
    manifests = _lines(spark, folder, "segments").select(F.col("key").cast("long").alias("second"), F.from_json("text", MANIFEST).alias("m")).groupBy("second").agg(F.flatten(F.collect_list(F.coalesce("m.frames", F.array().cast("array<string>")))).alias("frames"), F.count_if(F.col("m.frames").isNull()).alias("bad"))
    found = staged(wanted.join(manifests, "second", "left").withColumn("code", F.when(F.col("frames").isNull(), "segment.missing").when(F.col("bad") > 0, "segment.unreadable")))
    problems = problems.union(found.where("code is not null").select(named("segment", F.col("second"))))
    counts = found.where("code is null").select(F.explode(F.array_distinct("frames")).alias("hash")).groupBy("hash").agg(F.count("*").alias("refs"))
    index = frames.join(counts, "hash", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    return Rebuilt(index, commits, problems.select("p.*"))
