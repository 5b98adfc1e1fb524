"""Retention, tiers, budgets and costs as columns over rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Window widths and how long they are kept (seconds; 0: forever) of the retention ladder.
LADDER = ((15, 3600), (60, 86_400), (3600, 604_800), (86_400, 7_776_000), (2_592_000, 0))
#: Age in seconds from which a tier accepts an object.
TIERS = ((0, 0), (1, 604_800), (2, 2_592_000), (3, 7_776_000))
#: Ladder of use against budget, and what is done from there on.
BUDGET = ((0.8, "warn"), (1.0, "slow"), (1.25, "pause_files"), (1.5, "pause_all"))
GB, GIB, SECONDS_PER_MONTH = 1_000_000_000, 1 << 30, 2_629_800
#: Fixed value: seconds of the month that use is projected to for a budget (30.44 days).
BUDGET_MONTH = 2_630_016


def due_for_rollup(segments: DataFrame, now: int, ladder: tuple = LADDER) -> DataFrame:
    """Segments (level, second) that have been kept long enough to be folded into the next wider window: adds target (its start)."""
    out = segments.withColumn("due", F.lit(False)).withColumn("target", F.lit(None).cast("long"))
    for level, (_, keep) in enumerate(ladder[:-1]):
        wide = ladder[level + 1][0]
        due = (F.col("level") == level) & (F.lit(keep) > 0) & (F.col("second") + keep <= now)
        out = out.withColumn("due", F.col("due") | due).withColumn("target", F.when(due, F.col("second") - F.col("second") % wide).otherwise(F.col("target")))
    return out


def tier_for_age(age: Column, tiers: tuple = TIERS) -> Column:
    """The last tier whose threshold accepts an age."""
    return reduce(lambda c, t: F.when(age >= t[1], F.lit(t[0])).otherwise(c), tiers[1:], F.lit(tiers[0][0]))


def plan_promotions(objects: DataFrame, now: int, budget: int, pinned: str = "refs/") -> DataFrame:
    """Objects (object_key, tier, bytes, recorded) to move one tier on by age, oldest first, within a budget of bytes a source tier."""
    moves = objects.where(~F.col("object_key").startswith(pinned)).withColumn("wanted", tier_for_age(F.lit(now) - F.col("recorded"))).where(F.col("wanted") > F.col("tier"))
    # a running sum in order of age: whole days first, then within the day that the budget ends in
    moves = moves.withColumn("day", F.expr("recorded div 86400"))
    per_day = moves.groupBy("tier", "day").agg(F.sum("bytes").alias("_day"))
    before = Window.partitionBy("tier").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    per_day = per_day.select("tier", "day", F.coalesce(F.sum("_day").over(before), F.lit(0)).alias("_before")).where(F.col("_before") < budget)
    own = Window.partitionBy("tier", "day").orderBy("recorded", "object_key").rowsBetween(Window.unboundedPreceding, 0)
    out = moves.join(per_day, ["tier", "day"]).withColumn("running", F.col("_before") + F.sum("bytes").over(own)).where(F.col("running") <= budget)
    return out.select("object_key", "tier", (F.col("tier") + 1).alias("target"), "bytes", F.col("running").cast("long"))


def monthly_cost(bytes_: Column, writes: Column, reads: Column, prices: dict[str, float]) -> Column:
    """Dollars a month: what exceeds the free allowances, by unit prices (per GB and per million requests)."""
    over = lambda use, free: F.greatest(use - F.lit(float(free)), F.lit(0.0))
    return over(bytes_ / GB, prices.get("free_gb", 0)) * prices["gb"] + over(writes, prices.get("free_writes", 0)) / 1e6 * prices["writes"] + over(reads, prices.get("free_reads", 0)) / 1e6 * prices["reads"]


def assess_budget(use: DataFrame, bytes_col: str, requests_col: str, seconds: Column, byte_budget: float, request_budget: float) -> DataFrame:
    """use with share (the worse of bytes and requests scaled to a month, against their budgets) and the action on the ladder."""
    month = F.col(requests_col) * F.lit(float(BUDGET_MONTH)) / F.greatest(seconds, F.lit(1))
    share = F.greatest(F.col(bytes_col) / F.lit(float(byte_budget)), month / F.lit(float(request_budget)))
    action = reduce(lambda c, x: F.when(F.col("share") >= x[0], x[1]).otherwise(c), BUDGET, F.lit("none"))
    return use.withColumn("share", F.round(share, 6)).withColumn("action", action)


def expected_distinct(writes: Column, subjects: Column) -> Column:
    """Distinct subjects among so many random writes: n (1 - (1 - 1/n) ** w)."""
    return F.when(subjects <= 1, F.least(writes, subjects).cast("double")).otherwise(subjects * (1 - F.exp(writes * F.log(1 - 1 / subjects))))


def project_storage(shape: DataFrame) -> DataFrame:
    """By realm (writes, subjects, bytes a write): expected net operations of a window, what collapsing saves, bytes a year of 15 s windows."""
    net = expected_distinct(F.col("writes"), F.col("subjects"))
    out = shape.withColumn("net", F.round(net, 6)).withColumn("factor", F.round(F.when(net > 0, F.col("writes") / net).otherwise(1.0), 6))
    return out.withColumn("window_bytes", F.round(net * F.col("avg_bytes"), 6))


def tiers_needed(wanted: DataFrame, placement: DataFrame, tiers: tuple = TIERS) -> DataFrame:
    """Objects and bytes by tier that a restore needs: wanted (object_key, bytes) by where they are placed; one without placement may be in every tier."""
    placed = wanted.join(placement.select("object_key", "tier"), "object_key", "left")
    at = F.explode(F.when(F.col("tier").isNull(), F.array(*[F.lit(t) for t, _ in tiers])).otherwise(F.array(F.col("tier").cast("int"))))
    return placed.select("object_key", "bytes", F.col("tier").isNull().alias("unplaced"), at.alias("at")).groupBy(F.col("at").alias("tier")).agg(F.count("*").alias("objects"), F.sum("bytes").cast("long").alias("bytes"), F.count_if(F.col("unplaced")).alias("unplaced"))


def free_use(use: DataFrame, free: dict[str, int]) -> DataFrame:
    """use (storage, writes, reads) against free allowances: share and headroom of each axis, fits, and the axis nearest its end.

    Without an allowance a share is 0. Of equal shares the first of storage, writes, reads binds; without any allowance none does.
    """
    axes = ("storage", "writes", "reads")
    share = {a: F.col(a) / F.lit(float(free[a])) if free[a] > 0 else F.lit(0.0) for a in axes}
    most = F.greatest(*share.values())
    binding = reduce(lambda c, a: F.when(share[a] == most, a).otherwise(c), reversed(axes), F.lit(None).cast("string"))
    some = any(free[a] > 0 for a in axes)
    fits = reduce(lambda c, a: c & (F.col(a) <= free[a]), axes, F.lit(some))
    return use.select("*", *[F.round(share[a], 6).alias(f"{a}_share") for a in axes], *[F.greatest(F.lit(0), F.lit(free[a]) - F.col(a)).cast("long").alias(f"{a}_left") for a in axes], fits.alias("fits"), (binding if some else F.lit("")).alias("binding"))


def capacity(fits, ceiling: int = 100_000_000, steps: int = 24) -> Column:
    """The largest number of users that fits, by halving: fits is a function from a column (users) to a condition that holds up to some number.

    0 if one user doesn't fit, the ceiling if that many do. After `steps` halvings the lower end is given.
    """
    start = F.struct(F.lit(1).cast("long").alias("low"), F.lit(ceiling).cast("long").alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("long")
        open_, ok = at["high"] - at["low"] > 1, fits(middle)
        return F.struct(F.when(open_ & ok, middle).otherwise(at["low"]).alias("low"), F.when(open_ & ~ok, middle).otherwise(at["high"]).alias("high"))

    low = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["low"]
    return F.when(~fits(F.lit(1).cast("long")), F.lit(0).cast("long")).when(fits(F.lit(ceiling).cast("long")), F.lit(ceiling).cast("long")).otherwise(low)


def with_tier(tiers: Column, tier: Column) -> Column:
    """A placement (sorted tiers) with one more tier."""
    return F.array_sort(F.array_union(tiers, F.array(tier)))


def without_tier(tiers: Column, tier: Column) -> Column:
    """A placement with a tier less."""
    return F.array_remove(tiers, tier)


def read_order(tiers: Column, pinned: Column, ladder: tuple = TIERS) -> Column:
    """Tiers to try for an object: those recorded that exist, then the others from near to far. A pinned object is only in the nearest."""
    all_ = F.array(*[F.lit(t) for t, _ in ladder])
    known = F.filter(F.coalesce(tiers, F.array().cast("array<int>")), lambda t: F.array_contains(all_, t))
    return F.when(pinned, F.array(F.lit(ladder[0][0]))).otherwise(F.array_union(known, all_))


def rebuild_placement(listing: DataFrame) -> DataFrame:
    """Placements from what every tier lists (object_key, tier, bytes, recorded): tiers, bytes of the nearest copy, newest moment."""
    return listing.groupBy("object_key").agg(F.array_sort(F.collect_set("tier")).alias("tiers"), F.min_by("bytes", "tier").alias("bytes"), F.max("recorded").alias("recorded"))


def copy_proof(near: DataFrame, far: DataFrame) -> DataFrame:
    """Whether the near copy of each object (object_key, digest) may go: proved, differs or absent."""
    out = near.join(far.select("object_key", F.col("digest").alias("_far"), F.lit(True).alias("_there")), "object_key", "left")
    return out.select("object_key", F.when(F.col("_there").isNull(), "absent").when(F.col("digest") == F.col("_far"), "proved").otherwise("differs").alias("proof"))


def nearer_dependents(moves: DataFrame, frames: DataFrame, placement: DataFrame) -> DataFrame:
    """Planned moves (object_key, target) that must wait: frames of theirs are the delta parents of frames nearer, or of unknown place.

    frames: hash, parent, object_key. placement: object_key, tier (a row a copy). Gives dependents nearer and of unknown place.
    """
    nearest = placement.groupBy("object_key").agg(F.min("tier").alias("_at"))
    children = frames.where("parent is not null").select(F.col("parent").alias("hash"), "object_key").join(nearest, "object_key", "left").select("hash", "_at")
    moved = moves.join(frames.select("hash", "object_key"), "object_key").join(children, "hash")
    near, unknown = F.count_if(F.col("_at") < F.col("target")), F.count_if(F.col("_at").isNull())
    return moved.groupBy("object_key", "target").agg(near.alias("nearer"), unknown.alias("unknown")).where("nearer + unknown > 0")


def gauges(storage: DataFrame, commits: DataFrame, pending: DataFrame, open_by_severity: DataFrame, now: int) -> DataFrame:
    """Readings as (name, value, unit, attribute), from one row each of storage (frames, raw, stored, orphans), and the tables.

    pending: operations that no commit has. now is in microseconds; lag is 0 where there is no commit, and never negative.
    """
    c = commits.agg(F.count("*").alias("commits"), F.max("microtime").alias("newest"))
    p = pending.agg(F.count("*").alias("pending"), F.coalesce(F.sum("payload_length"), F.lit(0)).alias("pending_bytes"), F.min("microtime").alias("oldest"))
    one = storage.crossJoin(c).crossJoin(p)  # a row each
    lag = lambda t: F.coalesce(F.greatest(F.lit(0.0), (F.lit(now) - F.col(t)) / 1e6), F.lit(0.0))
    ratio = F.when(F.col("stored") > 0, F.col("raw") / F.col("stored")).otherwise(1.0)
    values = [
        ("stored_bytes", F.col("stored"), "By"), ("raw_bytes", F.col("raw"), "By"), ("frames", F.col("frames"), "{frame}"), ("orphan_frames", F.col("orphans"), "{frame}"), ("compression_ratio", F.round(ratio, 6), "1"),
        ("commits", F.col("commits"), "{commit}"), ("rpo_lag_seconds", F.round(lag("newest"), 3), "s"), ("flush_lag_seconds", F.round(lag("oldest"), 3), "s"), ("journal_pending", F.col("pending"), "{operation}"), ("journal_pending_bytes", F.col("pending_bytes"), "By"),
    ]
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"), F.lit(u).alias("unit"), F.lit("").alias("attribute")) for n, v, u in values])).alias("x")).select("x.*")
    return rows.unionByName(open_by_severity.select(F.lit("open_findings").alias("name"), F.col("n").cast("double").alias("value"), F.lit("{finding}").alias("unit"), F.concat(F.lit("severity="), F.col("severity").cast("string")).alias("attribute")))


#: Fixed value: the storage class of file blocks, which are read less often than they are kept.
INFREQUENT = "STANDARD_IA"


def storage_class(has_classes: Column, tier_blocks: bool = True, block_class: str | None = None) -> Column:
    """The class that blocks are put under: none where a store has no classes or blocks aren't tiered."""
    chosen = (block_class or "").strip() or INFREQUENT
    return F.when(F.coalesce(has_classes, F.lit(False)) & F.lit(tier_blocks), chosen)


#: Fixed values of the storage model: seconds, what an operation of a realm weighs, anchors and deployments, requests, and ratios.
SECONDS_PER_DAY, SECONDS_PER_MONTH, SECONDS_PER_YEAR, DAYS_PER_YEAR = 86_400, 2_629_800, 31_557_600, 365.25
OP_BYTES = {"access_event": 48, "access_delta": 184, "user_edit": 593, "node_edit": 870, "row_write": 217, "state_write": 217, "config_write": 2000}
TREE_BYTES_PER_CHANGED_SUBJECT, CODE_BYTES_PER_DEPLOY = 240.0, 62_772.0
WRITES_PER_FLUSH, COMPACTION_REWRITE_SHARE, COMPACTION_RATIO = 4, 0.05, 5.86


def op_bytes(realm: Column, deltas: Column) -> Column:
    """Bytes of one operation of a realm; an entity's are those of a visit, written as a delta or as an event."""
    weights = {"config": OP_BYTES["config_write"], "state": OP_BYTES["state_write"], "key_value": OP_BYTES["state_write"], "code": int(CODE_BYTES_PER_DEPLOY)}
    visit = F.when(deltas, OP_BYTES["access_delta"]).otherwise(OP_BYTES["access_event"])
    return reduce(lambda rest, w: F.when(realm == w[0], w[1]).otherwise(rest), weights.items(), F.when(realm == "entity", visit).otherwise(OP_BYTES["row_write"])).cast("long")


def estimate(sites: DataFrame) -> DataFrame:
    """Sites (subjects, ops_per_day, base_interval, segment_interval, retention_days, deploys_per_year; maybe measured_ratio) with the parts of their estimate.

    tree_bytes: what anchors hold while they are kept, each the distinct subjects written in its interval; code_bytes: what deployments do;
    writes_per_month: requests of flushes with what compaction writes again; ratio: the measured one, at least 1, else the model's.
    """
    kept = F.col("retention_days") / DAYS_PER_YEAR
    writes = F.round(F.col("ops_per_day") * (F.col("base_interval") / SECONDS_PER_DAY))
    bases = F.round(F.lit(float(SECONDS_PER_YEAR)) / F.col("base_interval")) * kept
    tree = F.when((F.col("subjects") < 1) | (F.col("ops_per_day") <= 0), 0.0).otherwise(bases * expected_distinct(writes, F.col("subjects").cast("double")) * TREE_BYTES_PER_CHANGED_SUBJECT)
    flushes = F.round(F.lit(float(SECONDS_PER_MONTH)) / F.col("segment_interval"))
    known = F.col("measured_ratio") if "measured_ratio" in sites.columns else F.lit(None).cast("double")
    ratio = F.when(known.isNull(), COMPACTION_RATIO).otherwise(F.greatest(F.lit(1.0), known))
    return sites.select(
        "*", F.round(tree).cast("long").alias("tree_bytes"), F.round(F.col("deploys_per_year") * kept * CODE_BYTES_PER_DEPLOY).cast("long").alias("code_bytes"),
        F.round(flushes * WRITES_PER_FLUSH * (1 + COMPACTION_REWRITE_SHARE)).cast("long").alias("writes_per_month"), ratio.alias("ratio"),
    )
