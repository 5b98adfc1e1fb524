"""What is captured: changes of rows field by field, writes of keys, and what lies in scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields whose change alone is no change of content, and fields of a user's visits.
IGNORED = ("changed", "revision_timestamp", "revision_uid", "revision_id", "vid")
ACCESS = ("access", "login", "init")
#: Prefix of tables with derived data, and the one such table without it.
CACHE_PREFIX, CACHE_TABLE = "cache_", "cachetags"


def row_changes(rows: DataFrame, key: list[str], order: list[str], fields: list[str], ignored: tuple[str, ...] = IGNORED, access: tuple[str, ...] = ()) -> DataFrame:
    """Each version of a row against the one before it: key, order, verb, changed (names), payload (name to new value), touch.

    Values are compared as text, so 1 and "1" are the same; null differs from any text. A first version is a create and
    has all fields. Fields of access are left out like ignored ones; touch: nothing but such fields moved.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    old = rows.withColumn("_old", F.lag(F.struct(*[F.col(f).cast("string").alias(f) for f in fields])).over(w))
    first = F.col("_old").isNull()
    moved = lambda f: ~F.col(f).cast("string").eqNullSafe(F.col(f"_old.{f}"))
    content = [f for f in fields if f not in ignored and f not in access]
    entries = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value"), (first | moved(f)).alias("on")) for f in content]), lambda e: e["on"])
    touched = F.greatest(F.lit(False), *[moved(f) for f in fields if f in access and f not in ignored], F.lit(False))
    out = old.withColumn("_e", entries)
    return out.select(
        *key, *order, F.when(first, "create").otherwise("update").alias("verb"), F.transform("_e", lambda e: e["key"]).alias("changed"),
        F.map_from_entries(F.transform("_e", lambda e: F.struct(e["key"], e["value"]))).alias("payload"), (~first & (F.size("_e") == 0) & touched).alias("touch"),
    )


def key_writes(writes: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Writes of keys as operations, one each: create where the key wasn't there, update, or delete (value null)."""
    before = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(*key).orderBy(*order))
    verb = F.when(F.col(value).isNull(), "delete").when(before.isNull() | before["v"].isNull(), "create").otherwise("update")
    return writes.select(*key, *order, verb.alias("verb"), value)


def in_scope(realms: tuple[str, ...], own_types: tuple[str, ...] = (), own_prefix: str = "", realm: str = "realm", subject: str = "subject") -> Column:
    """Whether an operation is captured: its realm is, its entity type isn't one of the library's own, its table neither own nor a cache."""
    head = F.substring_index(F.col(subject), ":", 1)
    own = head.isin(*own_types) if own_types else F.lit(False)
    cache = head.startswith(CACHE_PREFIX) | (head == CACHE_TABLE) | (head.startswith(own_prefix) if own_prefix else F.lit(False))
    return F.coalesce(F.col(realm).isin(*realms) & ~((F.col(realm) == "entity") & own) & ~((F.col(realm) == "table") & cache), F.lit(False))


def captured_since(ops: DataFrame, tables: DataFrame) -> DataFrame:
    """Whether anything of a table (table_name, since in seconds) was captured from then on: the table itself or table:row.

    Each subject counts for each of its prefixes that end before a colon; the newest moments are summed up before the join.
    """
    parts = F.transform(F.sequence(F.lit(1), F.size(F.split("subject", ":"))), lambda n: F.array_join(F.slice(F.split("subject", ":"), F.lit(1), n), ":"))
    newest = ops.where(F.col("realm").isin("table", "schema")).groupBy("subject").agg(F.max("microtime").alias("t"))
    newest = newest.select(F.explode(parts).alias("table_name"), "t").groupBy("table_name").agg(F.max("t").alias("t"))
    return tables.join(newest, "table_name", "left").select("table_name", "since", F.coalesce(F.col("t") >= F.col("since") * 1_000_000, F.lit(False)).alias("captured"))


def drifted_rows(table: DataFrame, key: str, changed: str | None, stored_max: Column | None, limit: int = 500) -> DataFrame:
    """The newest rows of a drifted table by key, of those that changed since the stored reading where that is known."""
    rows = table if changed is None or stored_max is None else table.where(F.col(changed) >= stored_max)
    return rows.orderBy(F.desc(key)).limit(limit)
