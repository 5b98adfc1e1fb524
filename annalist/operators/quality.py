"""Checks on data and history: table readings, drift, identity columns, findings, tripwires, drills, key classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Repair rungs in order, what a severity starts at.
RUNGS = ("observe", "reindex", "refetch", "rebuild", "quarantine", "refuse")
START = {3: "quarantine", 2: "reindex"}
#: Ordered glob rules of a key's class; the first that matches decides.
RULES = (
    ("cache:*", "ephemeral"), ("*:session:*", "ephemeral"), ("session:*", "ephemeral"), ("flood:*", "ephemeral"),
    ("queue:error:*", "durable"), ("queue:*", "transient"), ("blob:purchase:*", "durable"), ("blob:s*", "durable"),
)
#: Tripwires as (code, severity, condition over one observation row).
TRIPWIRES = (
    ("commit.parent_missing", 3, "missing_parents > 0"), ("frame.missing", 3, "missing_frames > 0"), ("frame.unindexed", 2, "unindexed > 0"),
    ("delta.chain_too_deep", 1, "deepest > 32"), ("flush.stale", 1, "lag_seconds > 86400"), ("segment.truncated", 2, "short_segments > 0"),
    ("watermark.drift", 1, "drifted > 0"), ("classification.unclassified_growth", 1, "unclassified * 4 > classified + unclassified and classified + unclassified >= 100"),
)
#: The wires that a sweep over a store trips, by what it counted; those on encryption are left out.
STORE_WIRES = (
    ("anchor.missing", 3, "missing_anchors > 0"), ("base.unreachable", 3, "broken_anchors > 0"), ("commit.parent_missing", 3, "missing_parents > 0"),
    ("delta.chain_too_deep", 1, "deep_chains > 0"), ("delta.parent_missing", 3, "missing_delta_parents > 0"), ("dict.missing", 3, "missing_dictionaries > 0"),
    ("file.shift_detected", 1, "shifted_files > 0"), ("flush.stale", 1, "lag_seconds > 86400"), ("frame.hash_mismatch", 3, "changed_frames > 0"),
    ("frame.missing", 3, "missing_frames > 0"), ("frame.unindexed", 2, "unindexed_frames > 0"), ("frame.unreadable", 2, "unreadable_frames > 0"),
    ("pack.short_read", 2, "short_packs > 0"), ("ref.missing", 3, "missing_refs > 0"), ("segment.truncated", 2, "unreadable_segments > 0"),
    ("tier.unreachable", 2, "unreachable_tiers > 0"), ("classification.unclassified_growth", 1, "unclassified * 4 > total_keys and total_keys >= 100"),
    ("code.vendor_drift", 2, "drifted_files > 0"), ("watermark.drift", 1, "drifted_tables > 0"),
)


def rank(col: Column, order: tuple[str, ...] = RUNGS) -> Column:
    """Place of a value in an order, -1 for others."""
    return reduce(lambda c, x: F.when(col == x[1], F.lit(x[0])).otherwise(c), enumerate(order), F.lit(-1))


def reading(table: DataFrame, name: str, key: str, changed: str, sample: int = 200) -> DataFrame:
    """A table's fingerprint: rows, greatest key and change, and a digest of its first rows in order of the key."""
    whole = table.agg(F.count("*").alias("row_count"), F.max(key).alias("max_key"), F.max(changed).alias("max_changed"))
    head = table.orderBy(key).limit(sample).agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns]).alias("r")))), lambda x: x["r"])), 256).alias("digest"))  # of so many rows
    return whole.crossJoin(head).select(F.lit(name).alias("table_name"), "row_count", "max_key", "max_changed", "digest")


def drift(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Tables whose reading differs from the stored one: state is new, unchanged or drifted, with what differs."""
    parts = ["row_count", "max_key", "max_changed", "digest"]
    old = stored.select("table_name", F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in parts])
    out = current.join(old, "table_name", "left")
    differs = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in parts]))
    state = F.when(F.col("_known").isNull(), "new").when(F.size(differs) == 0, "unchanged").otherwise("drifted")
    return out.select("table_name", state.alias("state"), F.when(F.col("_known").isNull(), "").otherwise(F.concat_ws(",", differs)).alias("differs"))


def identity_columns(table: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, distinct, unique) for each column, from one grouping of the table in long form."""
    long = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    per_value = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    return per_value.groupBy("column").agg(F.sum("n").cast("long").alias("rows"), F.count("v").alias("distinct"), (F.sum("n") == F.count("v")).alias("unique"))


def findings_summary(findings: DataFrame) -> DataFrame:
    """Open findings by code: worst severity, scopes, newest creation, highest rung; the worst first."""
    r = rank(F.col("rung"))
    out = findings.where(F.col("resolved").isNull()).groupBy("code").agg(F.max("severity").alias("severity"), F.count_distinct("scope").alias("scopes"), F.max("created").alias("created"), F.max_by("rung", r).alias("rung"), F.count("*").alias("n"))
    return out.orderBy(F.desc("severity"), "code")


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """Open findings for each severity from 0 to 3, zeros included; those of a code count under its worst severity."""
    per_code = findings.where(F.col("resolved").isNull()).groupBy("code").agg(F.max("severity").alias("severity"), F.count("*").alias("n"))
    spine = findings.sparkSession.range(4).select(F.col("id").alias("severity"))
    return spine.join(per_code.groupBy("severity").agg(F.sum("n").cast("long").alias("n"), F.count("*").alias("codes")), "severity", "left").na.fill(0, ["n", "codes"])


def ledger(events: DataFrame) -> DataFrame:
    """Open state by (code, scope) of a stream of findings: severity and rung never go down, opened at the first, announced if the first or a worsening.

    A window over each (code, scope), in order of created, id.
    """
    w = Window.partitionBy("code", "scope").orderBy("created", "id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("code", "scope").orderBy("created", "id").rowsBetween(Window.unboundedPreceding, -1)
    worst = F.max("severity").over(before)
    out = events.withColumn("worst", F.max("severity").over(w)).withColumn("rung_no", F.max(rank(F.col("rung"))).over(w)).withColumn("opened", F.min("created").over(w))
    return out.select("id", "code", "scope", "worst", F.col("rung_no").cast("long").alias("rung_no"), "opened", (worst.isNull() | (F.col("severity") > worst)).alias("announce"))


def glob(pattern: str) -> str:
    """A glob as an anchored regular expression: * is any text, ? one character."""
    special = set("\\.^$|()[]{}+")
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in pattern) + "$"


def classify(key: Column, rules: tuple = RULES) -> Column:
    """The class of a key by the first rule that matches; unclassified if none does."""
    return reduce(lambda c, r: F.when(key.rlike(glob(r[0])), r[1]).otherwise(c), reversed(rules), F.lit("unclassified"))


def discover(keys: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Keys and bytes by pattern (the text before the last colon) and class."""
    pattern = F.concat(F.regexp_replace("key", ":[^:]*$", ""), F.lit(":*"))
    return keys.groupBy(pattern.alias("pattern"), classify(F.col("key"), rules).alias("classification")).agg(F.count("*").alias("keys_seen"), F.sum(F.greatest("bytes", F.lit(0))).cast("long").alias("bytes_seen"))


def stored_pattern(keys: DataFrame, patterns: DataFrame) -> DataFrame:
    """Each key with the most specific stored glob (pattern, classification) that matches it: the longest without its stars, the first by name on ties.

    Patterns are few; they are broadcast only if at most 1,000, else the join is by their text before the first star.
    """
    n = patterns.limit(1001).count()
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("pattern", r"([.\\^$|()\[\]{}+])", r"\\$1"), r"\*", ".*"), F.lit("$"))
    p = patterns.select("pattern", "classification", regex.alias("_r"), F.length(F.regexp_replace("pattern", r"\*", "")).alias("_len"), F.substring_index("pattern", ":", 1).alias("_ns"))
    distinct = keys.select("key").distinct()
    if n <= 1000:
        matched = distinct.join(F.broadcast(p), F.expr("key rlike _r"))
    else:
        exact = p.where(~F.col("_ns").contains("*"))
        matched = distinct.withColumn("_k", F.substring_index("key", ":", 1)).join(exact, F.expr("_k = _ns and key rlike _r"))
    best = F.min_by(F.struct("pattern", "classification"), F.struct((-F.col("_len")).alias("l"), F.col("pattern").alias("p")))
    return matched.groupBy("key").agg(best.alias("x")).select("key", "x.*")


def unclassified_growth(discovered: DataFrame, least: int = 100, share: float = 0.25) -> DataFrame:
    """One row: all keys, unclassified ones, and whether these are so many that rules are missing."""
    out = discovered.agg(F.sum("keys_seen").cast("long").alias("total"), F.coalesce(F.sum(F.when(F.col("classification") == "unclassified", F.col("keys_seen"))), F.lit(0)).cast("long").alias("unclassified"))
    return out.withColumn("fires", (F.col("total") >= least) & (F.col("unclassified") > F.col("total") * share))


def tripwires(observation: DataFrame, wires: tuple = TRIPWIRES, whole: bool = False) -> DataFrame:
    """One row for each wire that an observation trips: code, severity, rung to start at; with whole, every wire and whether it fires."""
    rung = lambda s: START.get(s, "observe")
    rows = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), F.lit(rung(s)).alias("rung"), F.coalesce(F.expr(e), F.lit(False)).alias("fires")) for c, s, e in wires])
    out = observation.select(F.explode(rows).alias("x")).select("x.*")
    return out if whole else out.where("fires").drop("fires")


def stride_sample(subjects: DataFrame, key: str, size: int) -> DataFrame:
    """Every floor(n / size)-th subject in order of the key, `size` of them.

    Ranks come from counts of key ranges and from a window within each, so no task sorts all keys.
    """
    n = subjects.count()
    stride = max(1, n // size)
    ranged = subjects.withColumn("_p", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2)) if n == 0 else subjects.withColumn("_p", F.substring(F.col(key).cast("string"), 1, 7))
    per = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    base = per.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    numbered = ranged.join(base, "_p").withColumn("_r", F.col("_base") + F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1)
    return numbered.where((F.col("_r") % stride == 0) & (F.col("_r") < stride * size)).drop("_p", "_base", "_r")


def drill(stored: DataFrame, live: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Compare replayed fields with live ones, where both have the field: by subject the fields compared, those that differ, and a verdict."""
    on = [*key, "field"]
    both = stored.select(*on, F.col(value).alias("_s")).join(live.select(*on, F.col(value).alias("_l")), on)
    out = both.groupBy(*key).agg(F.count("*").alias("compared"), F.count_if(~F.col("_s").eqNullSafe(F.col("_l"))).alias("differed"))
    return out.withColumn("verdict", F.when(F.col("differed") > 0, "fail").otherwise("pass"))


def circuit_state(failures: Column, since: Column, limit: int = 3, cooldown: int = 300) -> Column:
    """closed below the limit of failures, else open, and half-open once the cooldown is over."""
    return F.when(failures < limit, "closed").when(since >= cooldown, "half-open").otherwise("open")


#: Names of columns that hold when a row changed, the first that is there being taken.
CHANGED_COLUMNS = ("changed", "updated", "timestamp", "created")


def order_column(columns: list[str]) -> str | None:
    """The column a table is read in order of: id, else the shortest that ends with id, else name, else the first."""
    if "id" in columns:
        return "id"
    ids = sorted((c for c in columns if c.endswith("id")), key=lambda c: (len(c), c))
    return ids[0] if ids else "name" if "name" in columns else columns[0] if columns else None


def changed_column(columns: list[str]) -> str | None:
    """The column that says when a row changed, if there is one."""
    return next((c for c in CHANGED_COLUMNS if c in columns), None)


def introspected(tables: dict[str, DataFrame]) -> DataFrame:
    """What tables are: table_name, columns, row_count, order_column, max_key, changed_column, max_changed; a row a table, from one pass over it."""
    spark = next(iter(tables.values())).sparkSession
    out: DataFrame | None = None
    for name, df in sorted(tables.items()):
        order, changed = order_column(df.columns), changed_column(df.columns)
        top = lambda c: F.max(c).cast("string") if c else F.lit(None).cast("string")
        one = df.agg(F.count("*").alias("row_count"), top(order).alias("max_key"), top(changed).alias("max_changed"))
        text = lambda c: F.lit(c).cast("string")
        row = one.select(F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("columns"), "row_count", text(order).alias("order_column"), "max_key", text(changed).alias("changed_column"), "max_changed")
        out = row if out is None else out.union(row)
    return out if out is not None else spark.createDataFrame([], "table_name string")


def store_observation(findings: DataFrame, **extra: DataFrame) -> DataFrame:
    """One row of counts for STORE_WIRES, from the findings (code, scope) of a sweep and one-row tables of other counts."""
    names = {"anchor.missing": "missing_anchors", "anchor.unwalkable": "broken_anchors", "commit.parent_missing": "missing_parents", "delta.chain_too_deep": "deep_chains", "delta.parent_missing": "missing_delta_parents",
             "dict.missing": "missing_dictionaries", "frame.hash_mismatch": "changed_frames", "frame.missing": "missing_frames", "frame.unindexed": "unindexed_frames", "entry.unreadable": "unreadable_frames",
             "ref.missing": "missing_refs", "segment.unreadable": "unreadable_segments"}
    row = findings.agg(*[F.count_if(F.col("code") == code).alias(n) for code, n in names.items()])
    for df in extra.values():
        row = row.crossJoin(df)  # one row each
    return row
