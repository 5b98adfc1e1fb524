"""The journal as a stream: sealed batches, windowed activity and the open state of findings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import collapse
from ..plans.staging import staged


def read_journal(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """Operations as files arrive in a folder, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def seal(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Write one batch's net effects as a segment. Writing the same batch again replaces it, so a retry leaves no second copy."""
    collapse(batch).withColumn("segment", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/segment={batch_id}")


def seal_stream(ops: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None, sink: Callable = seal):
    """Seal every micro-batch of a journal; the default trigger takes what there is and stops."""
    return ops.writeStream.foreachBatch(lambda df, n: sink(df, n, folder)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def activity(ops: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Operations and bytes by realm and window of event time; rows later than `late` are dropped, and windows leave the state then."""
    timed = ops.withColumn("at", F.timestamp_micros("microtime")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "realm").agg(F.count("*").alias("operations"), F.sum("payload_length").alias("bytes")).select(F.unix_micros("window.start").alias("bucket"), "realm", "operations", "bytes")


def ledger_stream(findings: DataFrame) -> DataFrame:
    """The running state of each (code, scope) of a stream of findings: worst severity, how many, and how often it got worse.

    State is three numbers a key, whatever comes; one row a key and batch.
    """
    out = "code string, scope string, worst long, n long, announced long"

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        worst, n, announced = state.get if state.exists else (-1, 0, 0)
        for df in rows:
            for s in df.sort_values(["created", "id"])["severity"]:
                n += 1
                if s > worst:
                    worst, announced = int(s), announced + 1
        state.update((worst, n, announced))
        yield pd.DataFrame({"code": [key[0]], "scope": [key[1]], "worst": [worst], "n": [n], "announced": [announced]})

    return findings.groupBy("code", "scope").applyInPandasWithState(update, out, "worst long, n long, announced long", "update", GroupStateTimeout.NoTimeout)


def _written(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    """A table of the journal, null before its first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(folder) if there else None


#: Characters of a label that are kept.
LABEL_LENGTH = 255
OFFSETS = "part int, first_sequence long, rows long, batch long"


def append(batch: DataFrame, batch_id: int, folder: str, order: tuple[str, ...] = ("microtime", "request")) -> None:
    """Append a micro-batch to the journal in a folder, numbering it on from the last sequence without gaps.

    Rows are numbered in the given order, which leaves no ties, over ranges of it: a range's rows and its first sequence are a row of
    the offset table, written last, which is the commit. A batch whose offsets stand is left alone, so a replay changes nothing; one that broke off
    is written again over its own files with the same numbers. An empty batch writes nothing.
    """
    spark = batch.sparkSession
    offsets = _written(spark, f"{folder}/offsets", OFFSETS)
    if offsets is not None and offsets.where(F.col("batch") == batch_id).limit(1).count():
        return
    last = 0 if offsets is None else offsets.where(F.col("batch") < batch_id).agg(F.coalesce(F.max(F.col("first_sequence") + F.col("rows") - 1), F.lit(0))).first()[0]
    label = [F.substring("label", 1, LABEL_LENGTH).alias("label")] if "label" in batch.columns else []
    rows = batch.select(*[c for c in batch.columns if c not in ("label", "sequence")], *label)
    dealt = staged(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = staged(counts.select("part", (before + last + 1).alias("first_sequence"), "rows"))  # one row a range
    if not starts.limit(1).count():
        return
    number = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    out = dealt.withColumn("_n", number).join(F.broadcast(starts.select("part", "first_sequence")), "part").withColumn("sequence", F.col("first_sequence") + F.col("_n"))
    out.drop("part", "_n", "first_sequence").write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
    starts.coalesce(1).write.mode("overwrite").parquet(f"{folder}/offsets/batch={batch_id}")


def appended(spark: SparkSession, folder: str) -> DataFrame:
    """The journal's rows of committed batches: what broke off before its offsets were written isn't read."""
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.join(spark.read.schema(OFFSETS).parquet(f"{folder}/offsets").select("batch").distinct(), "batch", "left_semi")


def append_stream(ops: DataFrame, folder: str, checkpoint: str, order: tuple[str, ...] = ("microtime", "request")):
    """Append every micro-batch of a stream of operations, taking what there is."""
    return ops.writeStream.foreachBatch(lambda df, n: append(df, n, folder, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
