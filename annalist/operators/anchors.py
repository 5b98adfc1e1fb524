"""Anchors: the index of subjects as it is written at the end of each interval, in full or as what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .history import REMOVALS

#: Microseconds between anchors, and how many there are from one full anchor to the next.
INTERVAL, FULL_EVERY = 14_400_000_000, 24


def entries(ops: DataFrame, interval: int = INTERVAL, size: str = "payload_length") -> DataFrame:
    """(history, subject, anchor, sequence, size): the newest operation of each subject in each interval; size is null where it removes the subject."""
    newest = F.max_by(F.struct("verb", F.col(size).cast("long").alias("size")), "sequence")
    rows = ops.groupBy(F.col("realm").alias("history"), "subject", F.expr(f"microtime div {interval}").alias("anchor")).agg(newest.alias("x"), F.max("sequence").alias("sequence"))
    return rows.select("history", "subject", "anchor", "sequence", F.when(~F.col("x.verb").isin(*REMOVALS), F.coalesce("x.size", F.lit(0))).alias("size"))


def written(found: DataFrame, first: int, last: int, full_every: int = FULL_EVERY) -> DataFrame:
    """(history, subject, anchor, full, size) of the anchors first to last over entries(): what each of them lists.

    A full anchor (the first, and each whose number full_every divides) lists every subject that exists then, whenever it was last
    written; the others list the interval's subjects, removed ones with a null size. Without entries there are no rows.
    """
    until = F.coalesce(F.lead("anchor").over(Window.partitionBy("history", "subject").orderBy("anchor")) - 1, F.lit(last))
    rows = found.where(F.col("anchor").between(first, last)).withColumn("_until", until)
    whole = (F.col("anchor") % full_every == 0) | (F.col("anchor") == first)
    deltas = rows.where(~whole).select("history", "subject", "anchor", F.lit(False).alias("full"), "size")
    next_full = F.expr(f"(anchor + {full_every - 1}) div {full_every} * {full_every}")
    at = F.when(next_full <= F.col("_until"), F.sequence(next_full, F.col("_until"), F.lit(full_every).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    at = F.when(F.col("anchor") == first, F.array_distinct(F.concat(F.array(F.lit(first).cast("long")), at))).otherwise(at)
    fulls = rows.where("size is not null").select("history", "subject", F.explode(at).alias("anchor"), F.lit(True).alias("full"), "size")
    return deltas.union(fulls)


def chain_of(anchors: DataFrame, number: int) -> DataFrame:
    """The rows of an anchor and of those before it, back to the nearest full one, as resolve_anchor() takes them: history, link, subject, size."""
    base = anchors.where(F.col("full") & (F.col("anchor") <= number)).agg(F.max("anchor").alias("_base"))
    return anchors.where(F.col("anchor") <= number).crossJoin(base).where("anchor >= _base").select("history", F.col("anchor").alias("link"), "subject", "size")  # one row
