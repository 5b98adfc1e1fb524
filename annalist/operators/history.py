"""Operations on the log of mutations: net effects, state at a moment, differences and merges.

All work is grouping and windows by subject, so it spreads over subjects; a subject's own history is what one task must
order. Ordering is by (sequence, microtime), which adapters make unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verbs that never combine with others, verbs that end a subject, realms kept verbatim.
BARRIERS, REMOVALS, VERBATIM = ("rename", "truncate", "ddl"), ("delete", "truncate"), ("schema", "file")


def collapse(ops: DataFrame, payload: str = "last", key: tuple[str, ...] = ("realm", "subject")) -> DataFrame:
    """Net effect of each subject's operations between barriers: verb, first and last sequence, fields, payload, n.

    A create that is later deleted leaves nothing; updates after a create stay a create; a delete after an update stays
    a delete; creates after anything else are updates. fields: names touched since the last create, or after the last
    delete, in order. payload "last" keeps the last operation's value, "merge" lists the last value of each field.
    Barriers and rows of verbatim realms are passed on unchanged, and a barrier ends the run before it.
    """
    order = ["sequence", "microtime"]
    by = Window.partitionBy(*key).orderBy(*order)
    plain = ~F.col("verb").isin(*BARRIERS) & ~F.col("realm").isin(*VERBATIM)
    rows = ops.withColumn("_run", F.sum(F.when(F.col("verb").isin(*BARRIERS), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = [*key, "_run"]
    w, whole = Window.partitionBy(*run).orderBy(*order), Window.partitionBy(*run)
    a = rows.where(plain).withColumn("_i", F.row_number().over(w))
    deletes = F.sum(F.when(F.col("verb") == "delete", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    a = a.withColumn("_g", F.coalesce(deletes, F.lit(0)))  # groups end with a delete
    a = a.withColumn("_head", F.first("verb").over(Window.partitionBy(*run, "_g").orderBy("_i")))
    a = a.withColumn("_open", F.min(F.when(F.col("_head") != "create", F.col("_g"))).over(whole)).withColumn("_last_g", F.max("_g").over(whole)).withColumn("_end", F.max("_i").over(whole))
    a = a.withColumn("_reset", F.max(F.when(F.col("verb") == "create", F.col("_i")).when(F.col("verb") == "delete", F.col("_i") + 1)).over(whole))
    from_group = F.coalesce("_open", "_last_g")
    a = a.withColumn("_start", F.min(F.when(F.col("_g") == from_group, F.col("_i"))).over(whole)).withColumn("_last", F.max(F.when(F.col("_i") == F.col("_end"), F.col("verb"))).over(whole))
    verb = F.when(F.col("_open").isNull(), F.when(F.col("_last") != "delete", "create")).otherwise(F.when(F.col("_last") == "delete", "delete").otherwise("update"))
    a = a.withColumn("_verb", verb).where(F.col("_verb").isNotNull() & (F.col("_i") >= F.col("_start")))
    touched = (F.col("_verb") == "update") & (F.col("_i") >= F.greatest("_start", F.coalesce("_reset", F.lit(0)))) | (F.col("_i") == F.col("_end"))
    fields = F.array_sort(F.collect_set(F.when(touched, F.col("field"))))
    last = F.max_by("field_json", "_i") if payload == "last" else F.to_json(F.map_from_entries(F.array_sort(F.collect_set(F.when(touched, F.struct("field", "_value"))))))
    if payload != "last":
        per_field = Window.partitionBy(*run, "field").orderBy(F.desc("_i"))
        a = a.withColumn("_value", F.first("field_json").over(per_field))
    net = a.groupBy(*run).agg(F.min("_verb").alias("verb"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), fields.alias("fields"), last.alias("payload"), F.count("*").alias("n"))
    kept = rows.where(~plain).select(*run, "verb", F.col("sequence").alias("first_sequence"), F.col("sequence").alias("last_sequence"), F.array("field").alias("fields"), F.col("field_json").alias("payload"), F.lit(1).cast("long").alias("n"))
    return net.unionByName(kept).drop("_run")


def collapse_statistics(ops: DataFrame, collapsed: DataFrame) -> DataFrame:
    """One row: operations before and after, how many went, and their ratio (1 if none is left)."""
    both = ops.agg(F.count("*").alias("before")).crossJoin(collapsed.agg(F.count("*").alias("after")))  # two single rows
    return both.select("before", "after", (F.col("before") - F.col("after")).alias("dropped"), F.round(F.when(F.col("after") > 0, F.col("before") / F.col("after")).otherwise(1.0), 6).alias("ratio"))


def rollup(ops: DataFrame, width: int) -> DataFrame:
    """collapse() within each window of so many microseconds: window, subject, net effect."""
    return collapse(ops.withColumn("window", F.col("microtime") - F.col("microtime") % width), key=("window", "realm", "subject"))


def replay(ops: DataFrame, until: int | None = None) -> DataFrame:
    """State of each (realm, subject, field) after the operations up to a sequence: the last value since the last removal."""
    rows = ops if until is None else ops.where(F.col("sequence") <= until)
    # newest payloads and removals by field are summed before the shuffle; the window is over a subject's fields, not its operations
    written = F.when(F.col("field_json").isNotNull(), F.col("sequence"))
    gone = F.max(F.when(F.col("verb").isin(*REMOVALS), F.col("sequence")))
    newest = rows.groupBy("realm", "subject", "field").agg(F.max_by("field_json", written).alias("value"), F.max(written).alias("sequence"), gone.alias("_gone"))
    reset = F.coalesce(F.max("_gone").over(Window.partitionBy("realm", "subject")), F.lit(-1))
    return newest.withColumn("_reset", reset).where(F.col("sequence") > F.col("_reset")).select("realm", "subject", "field", "value", "sequence")


def subjects_at(ops: DataFrame, until: int) -> DataFrame:
    """Subjects with a row at a sequence: exists, versions (removals and operations with a payload), last sequence."""
    rows = ops.where(F.col("sequence") <= until)
    versions = F.count_if(F.col("verb").isin(*REMOVALS) | F.col("field_json").isNotNull())
    return rows.groupBy("realm", "subject").agg((~F.max_by("verb", "sequence").isin(*REMOVALS)).alias("exists"), versions.alias("versions"), F.max("sequence").alias("sequence"))


def changed_since(ops: DataFrame, since: int) -> DataFrame:
    """Subjects whose newest operation is after a moment, deleted ones too: updated, deleted, size of the last payload."""
    index = ops.groupBy("realm", "subject").agg(F.max("microtime").alias("updated"), F.max_by("verb", "sequence").isin(*REMOVALS).alias("deleted"), F.max_by("payload_length", "sequence").alias("size"))
    return index.where(F.col("updated") > since)


def previous_version(ops: DataFrame) -> DataFrame:
    """Each operation with the payload before it of the same subject, and whether that differs."""
    w = Window.partitionBy("realm", "subject").orderBy("sequence")
    before = F.lag("field_json").over(w)
    return ops.select("sequence", "realm", "subject", "field_json", before.alias("previous"), (~F.col("field_json").eqNullSafe(before)).alias("changed"), ((F.row_number().over(w) - 1) % 33).cast("long").alias("delta_depth"))


def diff_fields(ops: DataFrame, before: int, after: int, realm: str | None = None) -> DataFrame:
    """Fields that differ between the states at two sequences: realm, subject, field, status, before, after.

    One pass: both states are folded from the same rows, those up to the later sequence.
    """
    rows = ops if realm is None else ops.where(F.col("realm") == realm)
    a, b = replay(rows, before).drop("sequence"), replay(rows, after).drop("sequence")
    key = ["realm", "subject", "field"]
    both = a.withColumnRenamed("value", "before").withColumn("_a", F.lit(True)).join(b.withColumnRenamed("value", "after").withColumn("_b", F.lit(True)), key, "full_outer")
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("status", status).where(F.col("status").isNotNull()).select(*key, "status", "before", "after")


def diff_subjects(ops: DataFrame, before: int, after: int) -> DataFrame:
    """Subjects that differ: added, removed or changed, with the number of fields that do."""
    fields = diff_fields(ops, before, after).groupBy("realm", "subject").agg(F.count("*").alias("n_fields"))
    a = subjects_at(ops, before).where("exists").select("realm", "subject", F.lit(True).alias("_a"))
    b = subjects_at(ops, after).where("exists").select("realm", "subject", F.lit(True).alias("_b"))
    out = fields.join(a, ["realm", "subject"], "left").join(b, ["realm", "subject"], "left")
    return out.select("realm", "subject", F.when(F.col("_a").isNull() & F.col("_b").isNotNull(), "added").when(F.col("_a").isNotNull() & F.col("_b").isNull(), "removed").otherwise("changed").alias("status"), "n_fields")


def merge_three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: list[str], value: str = "value", strategy: str = "refuse") -> DataFrame:
    """Merge two descendants of a base key by key: outcome, merged value.

    outcome: unchanged, ours, theirs, both (the same change), conflict. A missing row is an absence, unlike a null. Of a
    conflict, strategy "ours" or "theirs" takes that side; "refuse" keeps the base. Rows whose result is absent are kept
    with present = false.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.struct(F.col(value).alias("v")).alias(name))

    rows = side(base, "_b").join(side(ours, "_o"), key, "full_outer").join(side(theirs, "_t"), key, "full_outer")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    outcome = F.when(same("_o", "_b") & same("_t", "_b"), "unchanged").when(same("_t", "_b"), "ours").when(same("_o", "_b"), "theirs").when(same("_o", "_t"), "both").otherwise("conflict")
    conflict = {"ours": "_o", "theirs": "_t", "refuse": "_b"}[strategy]
    take = F.when(F.col("outcome").isin("ours", "both", "unchanged"), F.col("_o")).when(F.col("outcome") == "theirs", F.col("_t")).otherwise(F.col(conflict))
    return rows.withColumn("outcome", outcome).withColumn("_r", take).select(*key, "outcome", F.col("_r").isNotNull().alias("present"), F.col("_r.v").alias("value"))


def rows_at(ops: DataFrame, realm: str, until: int, fields: list[str]) -> DataFrame:
    """A realm's subjects at a sequence as rows with a column for each of the given fields (null: not set)."""
    state = replay(ops.where(F.col("realm") == realm), until)
    return state.groupBy("subject").pivot("field", fields).agg(F.first("value"))


def statement_kinds(statements: DataFrame, text: str = "statement") -> DataFrame:
    """Write statements as (verb, target table): comments, quotes and modifiers are stripped; others have verb null."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"/\*.*?\*/|--[^\n]*", " "), r"[`\"\[\]]", ""))
    verb = F.regexp_extract(plain, r"^(insert|replace|update|delete|truncate|create|alter|drop|rename)\b", 1)
    named = F.regexp_extract(plain, r"^(?:insert\s+(?:ignore\s+)?into|replace\s+into|update|delete\s+from|truncate\s+(?:table\s+)?|(?:create|alter|drop)\s+table\s+(?:if\s+(?:not\s+)?exists\s+)?|rename\s+table)\s*([a-z0-9_.{}]+)", 1)
    kind = F.when(verb.isin("insert", "replace"), "create").when(verb == "update", "update").when(verb == "delete", "delete").when(verb == "truncate", "truncate").when(verb.isin("create", "alter", "drop"), "ddl").when(verb == "rename", "rename")
    return statements.withColumn("verb", kind).withColumn("target", F.when(kind.isNotNull(), F.regexp_replace(named, r"[{}]", "")))


def most_consequential(ops: DataFrame, by: list[str], rank: Column) -> DataFrame:
    """One operation for each group: that of the highest rank, the last among equals, with the number of operations."""
    return ops.groupBy(*by).agg(F.max_by(F.struct("sequence", "verb", "subject"), F.struct(rank.alias("r"), F.col("sequence").alias("s"))).alias("x"), F.count("*").alias("n")).select(*by, "x.*", "n")
