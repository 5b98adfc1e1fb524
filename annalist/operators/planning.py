"""Plans of restores and merges: what would be written, what is left alone, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged
from . import graph, walks
from .history import REMOVALS, replay

#: Realms that a restore never writes back, the shortest abbreviation of an id, statuses, outcomes.
NOT_RESTORED, ABBREVIATION = ("ephemeral",), 8
STATUSES, OUTCOMES = ("restorable", "degraded", "unrestorable"), ("unchanged", "ours", "theirs", "merged", "conflict")
#: Why a subject isn't written: nothing of it can be read, only a part can, its realm is never written back.
SKIPPED = ("nothing_usable", "partly_unreadable", "realm_not_restored")
#: Fixed value: subjects that a refusal names.
NAMED = 20


def restore_plan(ops: DataFrame, until: int, fill_degraded: bool = False, not_restored: tuple[str, ...] = NOT_RESTORED, named: DataFrame | None = None, commit: Column | str | None = None) -> DataFrame:
    """Subjects at a sequence as a restore would treat them: exists, versions, unreadable, status, writable, skipped, depth.

    The plan is of the subjects that are there, those whose last operation isn't a deletion; with named (realm, subject) it is of just these,
    there or not. ops has a column readable (null: not readable). versions counts removals, which need no payload, and payloads
    that can be read; an operation without payload is no loss. Without versions a subject is unrestorable, with unreadable payloads
    beside them degraded, and degraded ones are written only if fill_degraded. skipped says why a subject isn't written. Realms that
    aren't restored are left out; named ones in them are skipped. depth: commits (a column of ops) that are replayed, null if it isn't given.
    """
    closed = lambda: F.coalesce(F.col("realm").isin(*not_restored), F.lit(False))
    rows = ops.where((F.col("sequence") <= until) & ~closed())
    gone, payload, readable = F.col("verb").isin(*REMOVALS), F.col("field_json").isNotNull(), F.coalesce("readable", F.lit(False))
    told = F.when(gone | ~payload | readable, ~gone)
    out = rows.groupBy("realm", "subject").agg(
        F.coalesce(F.max_by(told, F.when(told.isNotNull(), F.col("sequence"))), F.lit(False)).alias("exists"), F.count_if(gone | payload & readable).alias("versions"),
        F.count_if(~gone & payload & ~readable).alias("unreadable"), F.max_by("verb", "sequence").alias("_last"),
    )
    if named is None:
        out = out.where(~F.col("_last").eqNullSafe("delete"))
    else:
        both = out["realm"].eqNullSafe(named["realm"]) & out["subject"].eqNullSafe(named["subject"])
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        out = named.distinct().join(out, both, "left").select(named["realm"], named["subject"], F.coalesce("exists", F.lit(False)).alias("exists"), zero("versions"), zero("unreadable"))
    status = F.when(F.col("versions") == 0, "unrestorable").when(F.col("unreadable") == 0, "restorable").otherwise("degraded")
    out = out.withColumn("status", status).withColumn("writable", F.col("status").isin("restorable", *(["degraded"] if fill_degraded else [])) & ~closed())
    why = F.when(closed(), SKIPPED[2]).when(F.col("status") == "unrestorable", SKIPPED[0]).when(F.col("status") == "degraded", SKIPPED[1])
    out = out.withColumn("skipped", F.when(~F.col("writable"), why))
    depth = ops.where(F.col("sequence") <= until).agg((F.count_distinct(commit) if commit is not None else F.lit(None).cast("long")).alias("depth"))
    return out.select("realm", "subject", "exists", "versions", "unreadable", "status", "writable", "skipped").crossJoin(depth)  # one row


def counted(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """(column, n) for each of the given values, also those that no row has."""
    sums = rows.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(v).alias(column), F.col(v).alias("n")) for v in values])).alias("x")).select("x.*")


def concurrent_changes(plan: DataFrame, ops: DataFrame, planned_at: int) -> DataFrame:
    """Subjects that a plan would write and that changed after it was made: realm, subject, changed_at."""
    newer = ops.where(F.col("microtime") > planned_at).groupBy("realm", "subject").agg(F.max("microtime").alias("changed_at"))
    return newer.join(plan.where("writable").select("realm", "subject"), ["realm", "subject"], "left_semi")


def restore_holds(targets: DataFrame, findings: DataFrame) -> DataFrame:
    """Restore targets with what holds them: target, refused_by, quarantined_by (codes or null), held.

    Any open finding at the rung refuse holds every target; one at quarantine holds the commit its scope names, also by an
    abbreviation of 8 characters or more. Of several findings the least code is given.
    """
    open_ = findings.where("resolved is null")
    refused = open_.where("rung = 'refuse'").agg(F.min("code").alias("refused_by"))
    lengths = F.sequence(F.least(F.lit(ABBREVIATION), F.length("scope")), F.length("scope"))
    names = open_.where("rung = 'quarantine' and length(scope) > 0").select("code", F.explode(F.transform(lengths, lambda n: F.substring(F.col("scope"), F.lit(1), n))).alias("target"))
    names = names.groupBy("target").agg(F.min("code").alias("quarantined_by"))
    out = targets.join(names, "target", "left").crossJoin(refused)  # one row
    return out.select("target", "refused_by", "quarantined_by", (F.col("refused_by").isNotNull() | F.col("quarantined_by").isNotNull()).alias("held"))


def merge_objects(base: DataFrame, ours: DataFrame, theirs: DataFrame, strategy: str = "refuse") -> DataFrame:
    """Merge objects of (object, field, value) rows three ways: object, outcome, conflicts, from_ours, from_theirs, resolved.

    Fields are leaves (dotted paths of nested maps); an object without rows is absent. A removal against a change, and
    differing creations, conflict as a whole. The counts are of fields; resolved: not blocking under the strategy.
    """
    key = ["object", "field"]
    side = lambda df, n: df.select(*key, F.struct("value").alias(n))
    rows = side(base, "b").join(side(ours, "o"), key, "full_outer").join(side(theirs, "t"), key, "full_outer")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    here = F.col("o").isNotNull() | F.col("t").isNotNull()
    rows = rows.select("object", "b", "o", "t", (~same("o", "b")).alias("om"), (~same("t", "b")).alias("tm"), (~same("o", "t")).alias("ot"), here.alias("here"))
    by = rows.groupBy("object").agg(
        *[F.bool_or(F.col(c).isNotNull()).alias(f"in_{c}") for c in "bot"], *[F.bool_or(c).alias(f"any_{c}") for c in ("om", "tm", "ot")],
        F.count_if(F.col("here") & F.col("om") & F.col("tm") & F.col("ot")).alias("n_conflict"), F.count_if(F.col("here") & F.col("om") & ~F.col("tm")).alias("n_ours"), F.count_if(F.col("here") & F.col("tm") & ~F.col("om")).alias("n_theirs"),
    )
    whole = F.expr("(not in_t and in_o and not (in_b and not any_om)) or (not in_o and in_t and in_b and any_tm) or (in_o and in_t and not in_b and any_ot)")
    both = F.when(F.col("n_conflict") > 0, "conflict").when((F.col("n_theirs") == 0) & (F.col("n_ours") == 0), "unchanged").when(F.col("n_theirs") == 0, "ours").when(F.col("n_ours") == 0, "theirs").otherwise("merged")
    outcome = F.when(F.expr("not in_o and not in_t"), "unchanged").when(F.col("whole"), "conflict").when(~F.col("in_t"), "theirs").when(~F.col("in_o"), F.when(F.col("in_b"), "ours").otherwise("theirs")).otherwise(both)
    out = by.withColumn("whole", whole).withColumn("outcome", outcome)
    conflicts = F.when(F.col("whole"), F.lit(1).cast("long")).when(F.col("outcome") == "conflict", F.col("n_conflict")).otherwise(F.lit(0).cast("long"))
    return out.select("object", "outcome", conflicts.alias("conflicts"), F.col("n_ours").alias("from_ours"), F.col("n_theirs").alias("from_theirs"), ((F.col("outcome") != "conflict") | F.lit(strategy != "refuse")).alias("resolved"))


def branch_sets(edges: DataFrame, ours: int, theirs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What both tips reach and what their nearest common commit reaches, each (commit_no). Raises where there is no such commit."""
    found = walks.levels(edges)
    both = graph.reachable_of(edges, [ours, theirs], found)
    base = graph.common(both).first()
    if base is None:
        raise ValueError("the two histories share no commit")
    of = lambda df, k: df.where(F.col("label") == k).select(F.col("node").alias("commit_no"))
    return of(graph.reachable_of(edges, [base["node"]], found), 0), of(both, 0), of(both, 1)


def merge_plan(ops: DataFrame, sets: tuple[DataFrame, DataFrame, DataFrame], strategy: str = "refuse", realm: str = "config") -> DataFrame:
    """merge_objects() of a realm's subjects that commits after the common one touched on either side. ops has commit_no; sets as of branch_sets().

    Where theirs has no commit after the common one, all of it is merged already and the plan is empty.
    """
    base, ours, theirs = sets
    rows = ops.where(F.col("realm") == realm)
    ahead = ours.union(theirs).distinct().join(base, "commit_no", "left_anti")
    if not theirs.join(base, "commit_no", "left_anti").limit(1).count():
        ahead = ahead.limit(0)
    touched = staged(rows.join(ahead, "commit_no", "left_semi").select("subject").distinct())
    rows = rows.join(touched, "subject", "left_semi")
    at = lambda s: replay(rows.join(s, "commit_no", "left_semi")).select(F.col("subject").alias("object"), "field", "value")
    return touched.select(F.col("subject").alias("object")).join(merge_objects(at(base), at(ours), at(theirs), strategy), "object", "left").select(
        "object", F.coalesce("outcome", F.lit("unchanged")).alias("outcome"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("conflicts", "from_ours", "from_theirs")], F.coalesce("resolved", F.lit(True)).alias("resolved")
    )


def merge_refusals(ops: DataFrame, sets: tuple[DataFrame, DataFrame, DataFrame], realm: str = "config", named: int = NAMED) -> DataFrame:
    """Realms that a branch touched and that can't be merged: realm, subjects, the first of them by name, how many more."""
    base, _, theirs = sets
    subjects = ops.where(F.col("realm") != realm).join(theirs.join(base, "commit_no", "left_anti"), "commit_no", "left_semi").select("realm", "subject").distinct()
    first = subjects.withColumn("_r", F.row_number().over(Window.partitionBy("realm").orderBy("subject"))).where(F.col("_r") <= named)
    names = first.groupBy("realm").agg(F.array_sort(F.collect_list("subject")).alias("named"))
    return subjects.groupBy("realm").agg(F.count("*").alias("subjects")).join(names, "realm").withColumn("more", F.col("subjects") - F.size("named"))
