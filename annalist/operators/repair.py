"""The repair pass: which codes of open findings are repaired, by which rung, and what the next pass starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import RUNGS, circuit_state, rank

#: Rungs that a pass may run by itself, failures in a row that open a code's breaker, seconds until it is tried again.
AUTOMATIC, THRESHOLD, COOLDOWN = ("reindex", "refetch", "rebuild"), 3, 300


def repair_pass(findings: DataFrame, breakers: DataFrame, outcomes: DataFrame, now: int, budget: int | None = None, threshold: int = THRESHOLD, cooldown: int = COOLDOWN) -> DataFrame:
    """One row for each code with open findings: code, rung, open, worst, result, next_rung, failures, opened.

    findings: code, scope, severity, rung, resolved (null: open). A code is on the highest rung of any of its findings, open or not.
    breakers: code, failures, opened. outcomes: rung, ok: what the rung's run came to; a rung without a row fails. budget: codes that a rung
    may take in one pass, the worst first, then those with most findings.

    result: watched (observe), held (a person decides), waiting (the breaker is open), postponed (beyond the budget), repaired or
    failed. A failure leaves the findings open, counts against the code, opens its breaker from the threshold on, and sends
    it a rung up; a repair forgets its failures.
    """
    place = rank(F.col("rung"))
    codes = findings.groupBy("code").agg(F.max(place).alias("_at"), F.count_if(F.col("resolved").isNull()).alias("open"), F.max(F.when(F.col("resolved").isNull(), F.col("severity"))).alias("worst"))
    codes = codes.where("open > 0").withColumn("rung", F.element_at(F.array(*map(F.lit, RUNGS)), F.greatest("_at", F.lit(0)).cast("int") + 1))
    state = breakers.select("code", "failures", "opened")
    rows = codes.join(state, "code", "left").withColumn("failures", F.coalesce("failures", F.lit(0)).cast("long")).withColumn("opened", F.coalesce("opened", F.lit(0)).cast("long"))
    shut = circuit_state(F.col("failures"), F.lit(now) - F.col("opened"), threshold, cooldown) == "open"
    kind = F.when(F.col("rung") == RUNGS[0], "watched").when(~F.col("rung").isin(*AUTOMATIC), "held").when(shut, "waiting").otherwise("run")
    rows = rows.withColumn("_kind", kind)
    if budget is not None:
        turn = F.row_number().over(Window.partitionBy("rung", "_kind").orderBy(F.desc("worst"), F.desc("open"), "code"))  # a row a code
        rows = rows.withColumn("_kind", F.when((F.col("_kind") == "run") & (turn > budget), "postponed").otherwise(F.col("_kind")))
    rows = rows.join(outcomes.select("rung", F.col("ok").alias("_ok")), "rung", "left")
    ok = F.coalesce("_ok", F.lit(False))
    rows = rows.withColumn("result", F.when(F.col("_kind") != "run", F.col("_kind")).when(ok, "repaired").otherwise("failed"))
    failed, repaired = F.col("result") == "failed", F.col("result") == "repaired"
    failures = F.when(repaired, 0).when(failed, F.col("failures") + 1).otherwise(F.col("failures"))
    opened = F.when(repaired, 0).when(failed & (F.col("failures") + 1 >= threshold), now).otherwise(F.col("opened"))
    up = F.element_at(F.array(*map(F.lit, RUNGS)), F.least(rank(F.col("rung")) + 2, F.lit(len(RUNGS))).cast("int"))
    return rows.select("code", "rung", "open", "worst", "result", F.when(failed, up).otherwise(F.col("rung")).alias("next_rung"), failures.cast("long").alias("failures"), opened.cast("long").alias("opened"))


def after_pass(findings: DataFrame, report: DataFrame, now: int) -> DataFrame:
    """The findings as a pass leaves them: those of repaired codes are resolved, those of failed ones are on the next rung."""
    told = report.select("code", "result", "next_rung")
    rows = findings.join(told, "code", "left")
    cleared = (F.col("result") == "repaired") & F.col("resolved").isNull()
    changes = {"resolved": F.when(cleared, now).otherwise(F.col("resolved")), "rung": F.when(F.col("result") == "failed", F.col("next_rung")).otherwise(F.col("rung"))}
    return rows.select(*[changes.get(c, F.col(c)).alias(c) for c in findings.columns])


def breakers_after(breakers: DataFrame, report: DataFrame) -> DataFrame:
    """The breakers as a pass leaves them: codes with failures, those that weren't looked at too."""
    told = report.select("code", F.col("failures").alias("_f"), F.col("opened").alias("_o"))
    rows = breakers.join(told, "code", "full_outer").select("code", F.coalesce("_f", "failures").alias("failures"), F.coalesce("_o", "opened").alias("opened"))
    return rows.where("failures > 0")


def totals(report: DataFrame) -> DataFrame:
    """One row: codes considered, repaired, failed, held (by a person, a breaker or the budget), and findings cleared."""
    of = lambda *r: F.count_if(F.col("result").isin(*r))
    cleared = F.coalesce(F.sum(F.when(F.col("result") == "repaired", F.col("open"))), F.lit(0)).alias("cleared")
    return report.agg(F.count("*").alias("considered"), of("repaired").alias("repaired"), of("failed").alias("failed"), of("held", "waiting", "postponed").alias("held"), cleared)
