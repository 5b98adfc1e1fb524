"""Global row numbers and running sums without a window over all rows: ranges of the order are dealt to tasks, and only their sums meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged


def running(df: DataFrame, order: list, sums: dict[str, str] | None = None, least: dict[str, str] | None = None, most: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """df with running sums, minima and maxima over the rows in an order: each names the new column and the expression it is over.

    Rows are dealt by ranges of the order and written, so the ranges are fixed; a range's totals are one row, and a window over
    those rows (one a range, not a row of df) gives what each range starts from. Rows of equal order stand in one range, and which
    of them comes first is open. Nulls are passed over; an order may hold descending columns.
    """
    wanted = [(n, F.expr(e), f) for f, names in ((F.sum, sums), (F.min, least), (F.max, most)) for n, e in (names or {}).items()]
    dealt = df.repartitionByRange(*([parts] if parts else []), *order).withColumn("_part", F.spark_partition_id())
    kept = staged(dealt.sortWithinPartitions(*order))
    per = kept.groupBy("_part").agg(*[f(e).alias(f"_t_{n}") for n, e, f in wanted])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = per.select("_part", *[f(f"_t_{n}").over(before).alias(f"_t_{n}") for n, _, f in wanted])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = kept.select(*kept.columns, *[f(e).over(within).alias(n) for n, e, f in wanted]).join(F.broadcast(start), "_part")
    joined = {F.sum: lambda a, b: F.coalesce(a + b, a, b), F.min: F.least, F.max: F.greatest}
    return out.select(*df.columns, *[joined[f](F.col(n), F.col(f"_t_{n}")).alias(n) for n, _, f in wanted])


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """df with gap-free numbers from 0 in an order that leaves no ties."""
    return running(df, list(order), {name: "cast(1 as bigint)"}).withColumn(name, F.col(name) - 1)


def first_from(rows: DataFrame, probes: DataFrame, keys: list[str], number: str = "number", name: str = "found") -> DataFrame:
    """probes with the least number among the rows whose keys are equal to theirs or greater, where numbers rise with the keys; null if there is none.

    A search in sorted rows as one sort of both: from the greatest keys down, a probe takes the last number that passed by.
    """
    extra = [c for c in probes.columns if c not in keys]
    empty = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra]
    both = rows.select(*keys, F.col(number).alias("_number"), *empty, F.lit(False).alias("_probe")).unionByName(probes.select(*keys, F.lit(None).cast("long").alias("_number"), *extra, F.lit(True).alias("_probe")))
    return running(both, [*[F.desc(k) for k in keys], "_probe"], least={name: "_number"}).where("_probe").select(*keys, *extra, name)


def overlapping(rows: DataFrame, order: list[str], reach: int, size: int = 4096) -> DataFrame:
    """rows with _block, runs of `size` in an order without ties, each with the `reach` rows before it again (_own false), so that a window
    over a block sees what one over all rows would see so far back. reach is at most size."""
    at = numbered(rows, *order, name="_at")
    own = at.withColumn("_block", F.expr(f"_at div {size}")).withColumn("_own", F.lit(True))
    again = at.where(F.col("_at") % size >= size - reach).withColumn("_block", F.expr(f"_at div {size} + 1")).withColumn("_own", F.lit(False))
    return own.unionByName(again).drop("_at")
