"""Files as tables: trees of binary files, whole text files, and segments that are partitioned by level and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_tree(spark: SparkSession, root: str, glob: str = "*", most: int | None = None) -> DataFrame:
    """Files under a folder: path, length, modified, hash (SHA-256). A file over `most` bytes isn't read and has hash null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    if most is None:
        return files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"))
    small = files.where(F.col("length") <= most).select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"))
    large = files.where(F.col("length") > most).select("path", "length", F.col("modificationTime").alias("modified"), F.lit(None).cast("string").alias("hash"))
    return small.union(large)


def read_whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Text files as one row each: path, value."""
    return spark.read.option("wholetext", "true").text(paths).select(F.input_file_name().alias("path"), "value")


def write_segments(rows: DataFrame, folder: str, width: int, mode: str = "overwrite") -> None:
    """Write operations partitioned by level and window start (microseconds), one file a window, sorted by sequence."""
    out = rows.withColumn("level", F.lit(0)).withColumn("window_start", F.col("microtime") - F.col("microtime") % width)
    out.repartition("level", "window_start").sortWithinPartitions("sequence").write.mode(mode).partitionBy("level", "window_start").parquet(folder)


def read_segments(spark: SparkSession, folder: str, start: int, end: int, level: int = 0) -> DataFrame:
    """Operations of the windows that start in a range; other windows' files aren't opened."""
    return spark.read.parquet(folder).where((F.col("level") == level) & F.col("window_start").between(start, end))


def fingerprint(files: DataFrame, root: str = "") -> DataFrame:
    """One row: files and a digest over their paths and hashes. Per-file digests are combined by addition, so no task gathers the list."""
    one = F.conv(F.substring(F.sha2(F.concat_ws("|", F.regexp_replace("path", root, ""), "hash"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return files.agg(F.count("*").alias("files"), F.sha2(F.coalesce(F.sum(one), F.lit(0)).cast("string"), 256).alias("fingerprint"))


def compare_trees(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files that differ by path: added, removed or changed."""
    out = expected.select("path", F.col("hash").alias("_e"), F.lit(True).alias("_x")).join(actual.select("path", F.col("hash").alias("_a"), F.lit(True).alias("_y")), "path", "full_outer")
    status = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(~F.col("_e").eqNullSafe(F.col("_a")), "changed")
    return out.select("path", status.alias("status")).where("status is not null")
