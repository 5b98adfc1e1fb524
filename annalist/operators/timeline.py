"""Activity over time: dense buckets, totals, ranks within buckets, robust anomaly scores and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import overlapping

#: Widths in seconds of the resolution ladder.
RUNGS = (1, 5, 15, 60, 300, 3600, 21_600, 86_400, 604_800)
MAX_BUCKETS = 480
SECOND = 1_000_000


def resolution(seconds: int, most: int = MAX_BUCKETS, rungs: tuple[int, ...] = RUNGS) -> int:
    """The finest width, in seconds, that covers a span with at most so many buckets."""
    return next((r for r in rungs if seconds / r <= most), rungs[-1])


def bucket(micros: Column, width: int) -> Column:
    """Start of the bucket that a moment is in: integers only, so that all dialects agree."""
    return micros - micros % F.lit(width)


def spine(df: DataFrame, start: int, end: int, width: int) -> DataFrame:
    """All bucket starts from the one of start to end."""
    first = start - start % width
    return df.sparkSession.range(first, end + 1, width).select(F.col("id").alias("bucket"))


def buckets(commits: DataFrame, restores: DataFrame, start: int, end: int, width: int) -> DataFrame:
    """Every bucket between two moments (inclusive; microseconds) with what happened in it, zeros included.

    Both sides are summed to buckets before they meet the spine, so the joins have a row a bucket.
    """
    inside = F.col("microtime").between(start, end)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    per = commits.where(inside).groupBy(bucket(F.col("microtime"), width).alias("bucket")).agg(F.count("*").alias("commits"), zero("operations"), zero("raw_bytes"), zero("stored_bytes"), F.sum("is_base").cast("long").alias("bases"))
    at = F.col("started") * SECOND
    done = restores.where(at.between(start, end)).groupBy(bucket(at, width).alias("bucket")).agg(F.count("*").alias("restores"))
    out = spine(commits, start, end, width).join(per, "bucket", "left").join(done, "bucket", "left")
    return out.na.fill(0, ["commits", "operations", "raw_bytes", "stored_bytes", "bases", "restores"])


def totals(commits: DataFrame, start: int, end: int) -> DataFrame:
    """One row: the same sums over the whole window, and raw over stored bytes (1 if nothing is stored)."""
    out = commits.where(F.col("microtime").between(start, end)).agg(F.count("*").alias("commits"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("operations", "raw_bytes", "stored_bytes", "is_base")])
    return out.withColumn("ratio", F.round(F.when(F.col("stored_bytes") > 0, F.col("raw_bytes") / F.col("stored_bytes")).otherwise(1.0), 6))


def span(commits: DataFrame) -> DataFrame:
    """First and last moment of a history, and how many commits it has."""
    return commits.agg(F.min("microtime").alias("first"), F.max("microtime").alias("last"), F.count("*").alias("commits"))


def newest_per_bucket(commits: DataFrame, width: int, per_bucket: int = 32, overall: int = MAX_BUCKETS * 32) -> DataFrame:
    """At most per_bucket newest commits of each bucket, out of the newest `overall`: bucket, commit_no, rank."""
    newest = commits.orderBy(F.desc("microtime"), F.desc("commit_no")).limit(overall)
    order = Window.partitionBy("bucket").orderBy(F.desc("microtime"), F.desc("commit_no"))
    return newest.withColumn("bucket", bucket(F.col("microtime"), width)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_bucket).select("bucket", "commit_no", F.col("rank").cast("long"))


def cumulative_stored(per_bucket: DataFrame, now: int) -> DataFrame:
    """What was stored at the end of each bucket, if `now` bytes are stored after the last: never less than 0. A row a bucket."""
    later = Window.orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    return per_bucket.select("bucket", F.greatest(F.lit(0), F.lit(now) - F.coalesce(F.sum("stored_bytes").over(later), F.lit(0))).cast("long").alias("cumulative"))


def series(per_bucket: DataFrame, width: int) -> DataFrame:
    """Buckets as a long table: bucket, metric, value (operations a second, raw over stored bytes, stored bytes)."""
    ratio = F.when(F.col("stored_bytes") > 0, F.col("raw_bytes") / F.col("stored_bytes")).otherwise(1.0)
    metrics = {"operations_rate": F.col("operations") * SECOND / (width - 1), "ratio": ratio, "stored_bytes": F.col("stored_bytes").cast("double")}
    return per_bucket.select("bucket", F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*metrics.values()))).alias("metric", "value")).withColumn("value", F.round("value", 6))


#: Measurements of which only a fall is a symptom.
FALL_ONLY = ("dedup_ratio", "compression_ratio")


def robust_scores(readings: DataFrame, order: str, value: str, history: int = 128, least: int = 8, threshold: float = 4.0, floor: float = 0.05, by: list[str] = (), fall_only: Column | None = None) -> DataFrame:
    """Score each reading against the median of up to `history` earlier ones: (x - median) / max(1.4826 MAD, floor |median|).

    Readings with fewer than `least` earlier ones have score null. With no spread and no floor the distance is a share of the
    median, and at median 0 the value's sign. Where fall_only holds, only a fall is anomalous (see FALL_ONLY). Adds n_before, median, mad, score, anomalous.
    Readings without `by` are dealt in blocks that overlap by the history, so no task orders them all.
    """
    dealt = readings if by else overlapping(readings, [order], history)
    before = Window.partitionBy(*(by or ["_block"])).orderBy(order).rowsBetween(-history, -1)
    out = dealt.withColumn("_h", F.collect_list(F.col(value).cast("double")).over(before)).withColumn("n_before", F.size("_h").cast("long"))

    def middle(x: Column) -> Column:
        s, n = F.sort_array(x), F.size(x)
        return F.when(n == 0, F.lit(None).cast("double")).otherwise((F.element_at(s, F.expr("1") + F.floor((F.greatest(n, F.lit(1)) - 1) / 2).cast("int")) + F.element_at(s, F.expr("1") + F.floor(F.greatest(n, F.lit(1)) / 2).cast("int") - F.when(n == 0, 1).otherwise(0))) / 2)

    out = out.withColumn("median", middle(F.when(F.size("_h") > 0, F.col("_h")).otherwise(F.array(F.lit(0.0)))))
    out = out.withColumn("mad", middle(F.when(F.size("_h") > 0, F.transform("_h", lambda v: F.abs(v - F.col("median")))).otherwise(F.array(F.lit(0.0)))))
    scale = F.greatest(F.lit(1.4826) * F.col("mad"), F.lit(floor) * F.abs("median"))
    gap = F.col(value).cast("double") - F.col("median")
    score = F.when(F.col("n_before") < least, F.lit(None).cast("double")).when(scale > 0, gap / scale).when(F.col("median") != 0, gap / F.abs("median")).otherwise(F.signum(gap))
    out = out.withColumn("score", F.round(score, 6)).withColumn("anomalous", F.coalesce(F.abs("score") >= threshold, F.lit(False)))
    if fall_only is not None:
        out = out.withColumn("anomalous", F.col("anomalous") & (~fall_only | (F.col("score") < 0)))
    return out.drop("_h") if by else out.where("_own").drop("_h", "_block", "_own")


def operation_rate(commits: DataFrame) -> DataFrame:
    """Operations an hour since the commit before; 0 for the first and for gaps of under a second."""
    dealt = overlapping(commits.select("commit_no", "microtime", "operations"), ["microtime", "commit_no"], 1)
    elapsed = (F.col("microtime") - F.lag("microtime").over(Window.partitionBy("_block").orderBy("microtime", "commit_no"))) / SECOND
    return dealt.select("_own", "commit_no", F.round(F.when(elapsed >= 1, F.col("operations") / elapsed * 3600).otherwise(0.0), 6).alias("rate")).where("_own").drop("_own")


def as_of(commits: DataFrame, probes: DataFrame) -> DataFrame:
    """The newest commit at or before each probe (probe_id, at): one sort of both together, no pairs.

    Rows are dealt by ranges of time; a range's last commit is carried to the next ones through a table with a row a
    range, so no task sees the whole history.
    """
    day = 86_400 * SECOND
    both = commits.select(F.col("microtime").alias("t"), F.lit(0).alias("kind"), F.col("commit_no").alias("c"), F.lit(None).cast("long").alias("probe_id"))
    both = both.union(probes.select("at", F.lit(1), F.lit(None).cast("long"), "probe_id")).withColumn("range", F.expr(f"t div {day}"))
    order = Window.partitionBy("range").orderBy("t", "kind", "c").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("own", F.last("c", ignorenulls=True).over(order))
    last = both.groupBy("range").agg(F.max_by("c", F.when(F.col("c").isNotNull(), F.struct("t", "c"))).alias("c"))
    carried = last.select("range", F.last("c", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return inside.where("kind = 1").join(carried, "range", "left").select("probe_id", F.col("t").alias("at"), F.coalesce("own", "carried").alias("commit_no"))
