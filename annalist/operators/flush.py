"""The micro-batches that journals flush in, without a task that holds a whole journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged
from .graph import follow
from .ranges import first_from, running

#: Which bound fired, in the order in which they are asked.
REASONS = ("count", "bytes", "age", "end")


def flush_batches(ops: DataFrame, by: str = "realm", age: int = 15_000_000, count: int = 5000, size: int = 4 << 20) -> DataFrame:
    """The micro-batches that a journal flushes in: by, batch, first and last sequence, operations, bytes, reason.

    A batch ends before the operation at which its oldest is `age` microseconds old, and with the one that brings it to `count` operations
    or `size` bytes; the last one of a journal may be open ("end"). The clock of a journal is the latest microtime so far, so late
    operations don't turn it back. Null payload lengths and microtimes count as nothing.

    Where a batch ends depends on where it starts, so each operation points at the one that would start the next batch if it started
    one itself: by running sums, and a search for the first operation past each bound. What the pointers reach from a journal's first
    operation, by doubling them, are the starts: rounds grow with the logarithm of the number of batches.
    """
    kind = ops.schema[by].dataType
    rows = ops.select(F.col(by).alias("_by"), "sequence", F.coalesce("microtime", F.lit(0)).alias("_t"), F.coalesce("payload_length", F.lit(0)).cast("long").alias("_len"))
    rows = rows.withColumn("_null", F.col("_by").isNull()).withColumn("_by", F.coalesce("_by", F.lit("").cast(kind)))
    key = ["_null", "_by"]
    at = running(rows, [*key, "sequence"], sums={"_n": "cast(1 as bigint)", "_sum": "_len"}, most={"_clock": "struct(_null, _by, _t as t)"})
    at = staged(at.select(*key, "sequence", "_n", (F.col("_sum") - F.col("_len")).alias("_from"), "_sum", F.col("_clock.t").alias("_clock")))
    journals = at.groupBy(*key).agg(F.min("_n").alias("_first"), F.max("_n").alias("_last"))
    found = at
    for col, bound, name in (("_clock", age, "_aged"), ("_from", size, "_full")):
        probes = found.select(*[c for c in found.columns if c != col], F.col(col).alias("_was"), (F.col(col) + bound).alias(col))
        found = first_from(at, probes, [*key, col], "_n", name).drop(col).withColumnRenamed("_was", col)
    found = found.join(F.broadcast(journals), key)  # one row a journal
    within = lambda c: F.when(F.col(c) <= F.col("_last"), F.col(c))  # noqa: E731  # a search may end in the next journal
    ends = found.withColumn("_counted", F.col("_n") + count).withColumn("_aged", within("_aged")).withColumn("_full", within("_full"))
    ends = staged(ends.withColumn("_next", F.least("_aged", "_full", within("_counted"))))
    starts = follow(journals.select(F.col("_first").alias("node"), F.lit(0).alias("depth")), ends.where("_next is not null").select(F.col("_n").alias("node"), F.col("_next").alias("up")))
    batches = ends.join(starts.select(F.col("node").alias("_n"), F.col("depth").alias("batch")), "_n").withColumn("_stop", F.coalesce(F.col("_next") - 1, F.col("_last")))
    last = at.select(F.col("_n").alias("_stop"), F.col("sequence").alias("last_sequence"), F.col("_sum").alias("_until"))
    out = batches.join(last, "_stop").withColumn("operations", F.col("_stop") - F.col("_n") + 1).withColumn("bytes", F.col("_until") - F.col("_from"))
    reason = F.when(F.col("operations") >= count, REASONS[0]).when(F.col("bytes") >= size, REASONS[1]).when(F.col("_next").isNotNull(), REASONS[2]).otherwise(REASONS[3])
    return out.select(F.when(~F.col("_null"), F.col("_by")).alias(by), "batch", F.col("sequence").alias("first_sequence"), "last_sequence", "operations", "bytes", reason.alias("reason"))
