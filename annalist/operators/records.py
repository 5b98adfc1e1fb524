"""Records of what was done: the audit trail of restores, drills, and branches as the requests for them leave them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Outcomes of a restore that isn't over and of one that was refused, characters of a scope, verdicts of drills.
PENDING, REFUSED, SCOPE_LENGTH = "pending", "refused", 255
VERDICTS = ("passed", "failed", "inconclusive", "refused")
#: The branch that is always there, characters of a name, what a name and a commit address may be, where refs of branches lie.
TRUNK, NAME_LENGTH, NAME, ADDRESS, HEADS = "main", 128, r"^[a-z0-9][a-z0-9_-]*(/[a-z0-9][a-z0-9_-]*)*$", r"^[0-9a-f]{64}$", "heads/"


def audit(opens: DataFrame, closes: DataFrame, refusals: DataFrame) -> DataFrame:
    """The audit trail: id, started, finished, actor, target, pre_snapshot, scope, mode, outcome, restored, skipped.

    opens: id, started, actor, target, pre_snapshot, scope, mode, skipped. closes: id, finished, outcome, restored, skipped; the last one of an
    id counts, and one without an open restore is nothing. refusals: id, started, actor, target, scope, mode, subjects: these end when
    they start, and all their subjects are skipped. A restore that isn't closed is pending and has restored nothing.
    """
    last = closes.groupBy("id").agg(F.max_by(F.struct("finished", "outcome", "restored", "skipped"), "finished").alias("c"))
    cut = F.substring("scope", 1, SCOPE_LENGTH).alias("scope")
    rows = opens.join(last, "id", "left").select(
        "id", "started", F.col("c.finished").alias("finished"), "actor", "target", "pre_snapshot", cut, "mode", F.coalesce("c.outcome", F.lit(PENDING)).alias("outcome"), F.coalesce("c.restored", F.lit(0)).cast("long").alias("restored"), F.coalesce("c.skipped", "skipped").cast("long").alias("skipped"),
    )
    none = F.lit(None).cast(opens.schema["pre_snapshot"].dataType).alias("pre_snapshot")
    return rows.union(refusals.select("id", "started", F.col("started").alias("finished"), "actor", "target", none, cut, "mode", F.lit(REFUSED).alias("outcome"), F.lit(0).cast("long").alias("restored"), F.col("subjects").cast("long").alias("skipped")))


def recent(rows: DataFrame, at: str, limit: int, most: int = 10_000) -> DataFrame:
    """The newest rows by a moment, then by id, at most `most`; a limit under one gives one."""
    return rows.orderBy(F.desc(at), F.desc("id")).limit(min(max(1, limit), most))


def verdicts(drills: DataFrame, limit: int = 30) -> DataFrame:
    """(verdict, n) over the newest drills, also for verdicts that none has."""
    newest = recent(drills, "created", limit)
    sums = newest.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("n")) for v in VERDICTS])).alias("x")).select("x.*")


def fine_name(name: Column) -> Column:
    """Whether a branch may have a name: steps of small letters, digits, - and _ between slashes, not too long."""
    return F.coalesce((F.length(name) <= NAME_LENGTH) & name.rlike(NAME), F.lit(False))


def branch_requests(requests: DataFrame) -> DataFrame:
    """What becomes of each request to create or delete a branch: name, number, action, commit, result.

    requests: number (their order), action (create, delete), name, commit (what a new branch is cut from), actor, at. A branch is created only
    if its name and commit are fine and it isn't there; the trunk is neither created nor deleted. Whether a branch is there follows
    from the last request for its name that could change it, so no request waits for another name's.
    """
    name = F.col("name")
    sound = fine_name(name) & (name != TRUNK)
    can = sound & F.when(F.col("action") == "create", F.coalesce(F.col("commit").rlike(ADDRESS), F.lit(False))).otherwise(F.col("action") == "delete")
    rows = requests.withColumn("_can", can)
    before = F.last(F.when(F.col("_can"), F.col("action") == "create"), ignorenulls=True).over(Window.partitionBy("name").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_there", F.coalesce(before, F.lit(False)))
    create, there = F.col("action") == "create", F.col("_there")
    result = F.when(~F.col("action").isin("create", "delete") | F.col("action").isNull(), "unknown").when(~fine_name(name), "bad_name").when(name == TRUNK, "trunk").when(create & ~F.col("_can"), "bad_commit")
    result = result.when(create & there, "exists").when(create, "created").when(there, "deleted").otherwise("absent")
    return rows.select(*requests.columns, result.alias("result"))


def branches(requests: DataFrame) -> DataFrame:
    """The branches that requests leave: name, ref, forked_from, tip, actor, created, newest first when listed by created and name."""
    done = branch_requests(requests).where(F.col("result").isin("created", "deleted"))
    last = done.groupBy("name").agg(F.max_by(F.struct("result", "commit", "actor", "at"), "number").alias("x")).where(F.col("x.result") == "created")
    return last.select("name", F.concat(F.lit(HEADS), "name").alias("ref"), F.col("x.commit").alias("forked_from"), F.col("x.commit").alias("tip"), F.col("x.actor").alias("actor"), F.col("x.at").alias("created"))


def branch_tips(found: DataFrame, commits: DataFrame) -> DataFrame:
    """Branches with whether their tip is there among commits (commit): those that aren't are lost refs."""
    there = commits.select(F.col("commit").alias("tip"), F.lit(True).alias("_there")).distinct()
    return found.join(there, "tip", "left").select(*found.columns, F.col("_there").isNull().alias("lost"))
