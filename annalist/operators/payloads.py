"""Nested payloads: JSON of any depth as rows of leaves, and what changes between versions of an object leaf by leaf."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged

#: Fixed value: levels of nested maps that are opened; what lies deeper stays one leaf.
MAX_DEPTH = 32


def _kind(v):
    """The kind of a variant's value, without what it holds."""
    return F.lower(F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0))


def leaves(df: DataFrame, key: list[str], body: str, depth: int = MAX_DEPTH) -> DataFrame:
    """Rows (key, path, kind, value) of JSON texts: maps are opened level by level, and dotted paths lead to what isn't a map.

    Lists and empty maps are leaves: their value is JSON with the keys of maps in order, so equal settings have equal values. A string's
    value is its text, whatever it looks like; kind tells it from a number, a truth value or a null (void, value null). A text
    that is null, no JSON or no map or list has no rows; a list at the top is opened by its places. Keys of rows may repeat.
    """
    v = F.try_parse_json(body)
    opened = df.select(*[F.col(k) for k in key], v.alias("_v")).where(F.col("_v").isNotNull()).withColumn("_kind", _kind(F.col("_v")))
    opened = opened.where(F.col("_kind").isin("object", "array")).withColumn("path", F.lit(None).cast("string"))
    spark = df.sparkSession
    out: DataFrame | None = None
    for level in range(depth + 1):
        # the function's columns come last, whatever the key's are named
        each = opened.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).toDF(*opened.columns, "_pos", "_key", "_value")
        name = F.concat_ws(".", "path", F.coalesce("_key", F.col("_pos").cast("string")))
        each = each.select(*key, name.alias("path"), F.col("_value").alias("_v"), _kind(F.col("_value")).alias("_kind"))
        is_map = (F.col("_kind") == "object") & (F.to_json("_v") != "{}") if level < depth else F.lit(False)
        each = staged(each.withColumn("_map", is_map))
        here = each.where(~F.col("_map")).select(*key, "path", F.col("_kind").alias("kind"), _text().alias("value"))
        out = here if out is None else out.union(here)
        opened = each.where("_map").drop("_map")
        if not opened.limit(1).count():
            break
    return out


def _text():
    kind = F.col("_kind")
    return F.when(kind == "string", F.variant_get("_v", "$", "string")).when(kind != "void", F.to_json("_v"))


def config_changes(versions: DataFrame, key: list[str], order: list[str], body: str) -> DataFrame:
    """What each version of an object changes: key, version (from 1), path, change (set, changed, removed), kind, before, value.

    Leaves are compared with those of the version before, so 1, "1", null and a missing setting are four different things, and the order
    of a map's keys is none. The first version sets all its leaves; a version that can't be read counts as one without any.
    """
    number = F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")
    rows = versions.withColumn("version", number).withColumn("_last", F.count("*").over(Window.partitionBy(*key)))
    found = leaves(rows.select(*key, "version", "_last", body), [*key, "version", "_last"], body)
    side = F.struct("kind", "value")
    now = found.select(*key, "version", "path", side.alias("_now"), F.lit(None).cast(found.select(side.alias("s")).schema["s"].dataType).alias("_was"))
    then = found.where("version < _last").select(*key, (F.col("version") + 1).alias("version"), "path", F.lit(None).cast(now.schema["_was"].dataType), side)
    both = now.union(then).groupBy(*key, "version", "path").agg(F.max("_now").alias("_now"), F.max("_was").alias("_was")).where("not (_now <=> _was)")
    change = F.when(F.col("_was").isNull(), "set").when(F.col("_now").isNull(), "removed").otherwise("changed")
    return both.select(*key, "version", "path", change.alias("change"), F.coalesce("_now.kind", "_was.kind").alias("kind"), F.col("_was.value").alias("before"), F.col("_now.value").alias("value"))
