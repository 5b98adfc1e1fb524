"""Classes of keys in a shared store: ordered rules, decisions made by people, profiles that carry these elsewhere, and why a key is kept or not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a key's loss means, who decided, the version of a profile.
AUTHORITATIVE, DERIVABLE, UNCLASSIFIED = "authoritative", "derivable", "unclassified"
RULE, HUMAN, PROFILE_VERSION = "heuristic", "human", 1
#: Patterns with the class of the keys that match them; the first that matches decides.
KEY_RULES = (
    ("key_value_expire*", DERIVABLE),
    ("keyvalue.expirable*", DERIVABLE),
    ("*expirable*", DERIVABLE),
    ("*_expire*", DERIVABLE),
    ("*.expire", DERIVABLE),
    ("tempstore*", DERIVABLE),
    ("queue*", AUTHORITATIVE),
    ("*.queue", AUTHORITATIVE),
    ("reliable_queue*", AUTHORITATIVE),
    ("flood*", AUTHORITATIVE),
    ("session*", AUTHORITATIVE),
    ("php_session*", AUTHORITATIVE),
    ("semaphore*", AUTHORITATIVE),
    ("key_value*", AUTHORITATIVE),
    ("keyvalue*", AUTHORITATIVE),
    ("lock*", DERIVABLE),
    ("cache*", DERIVABLE),
    ("*_cache", DERIVABLE),
    ("cachetags*", DERIVABLE),
    ("render*", DERIVABLE),
    ("page*", DERIVABLE),
    ("dynamic_page_cache*", DERIVABLE),
    ("discovery*", DERIVABLE),
    ("bootstrap*", DERIVABLE),
    ("config*", DERIVABLE),
    ("container*", DERIVABLE),
    ("menu*", DERIVABLE),
    ("entity*", DERIVABLE),
    ("data*", DERIVABLE),
    ("default*", DERIVABLE),
    ("jsonapi*", DERIVABLE),
    ("library*", DERIVABLE),
    ("toolbar*", DERIVABLE),
)


def normal(key: Column) -> Column:
    """A key as patterns see it: trimmed, in lower case, null as empty."""
    return F.lower(F.trim(F.coalesce(key, F.lit(""))))


def glob(pattern: str) -> str:
    """The regular expression of a pattern whose only wildcard is the star."""
    return "(?s)^" + ".*".join("".join(c if c.isalnum() or c == "_" else "\\" + c for c in part) for part in pattern.strip().lower().split("*")) + "$"


def rule_of(key: Column) -> Column:
    """(pattern, classification) of the first rule that matches a key, null where none does. The empty key has none."""
    one = lambda rule: F.struct(F.lit(rule[0]).alias("pattern"), F.lit(rule[1]).alias("classification"))
    first = reduce(lambda rest, rule: F.when(normal(key).rlike(glob(rule[0])), one(rule)).otherwise(rest), reversed(KEY_RULES), F.lit(None).cast("struct<pattern:string,classification:string>"))
    return F.when(normal(key) != "", first)


def namespace_of(key: Column) -> Column:
    """A key up to its first colon or dot."""
    return F.regexp_extract(normal(key), "^[^:.]*", 0)


def classified(keys: DataFrame, decisions: DataFrame | None = None, key: str = "key") -> DataFrame:
    """keys with namespace, pattern, classification and source.

    decisions: (pattern, classification, source), of which a person's is asked before the rules: one for the pattern that a rule gives
    the key or, without a rule, for its namespace with a star. Other keys are unclassified; the source is null then.
    """
    rule = rule_of(F.col(key))
    rows = keys.withColumn("namespace", namespace_of(F.col(key))).withColumn("_rule", rule)
    rows = rows.withColumn("pattern", F.coalesce("_rule.pattern", F.concat("namespace", F.lit("*"))))
    if decisions is not None:
        human = decisions.where(F.col("source") == HUMAN).select("pattern", F.col("classification").alias("_decided"))
        rows = rows.join(human, "pattern", "left")
    else:
        rows = rows.withColumn("_decided", F.lit(None).cast("string"))
    class_ = F.coalesce("_decided", "_rule.classification", F.lit(UNCLASSIFIED))
    source = F.when(F.col("_decided").isNotNull(), HUMAN).when(F.col("_rule").isNotNull(), RULE)
    return rows.withColumn("classification", class_).withColumn("source", source).select(*[c for c in keys.columns], "namespace", "pattern", "classification", "source")


def explained(rows: DataFrame, capture: bool = True) -> DataFrame:
    """classified() rows with captured, restored and why (a code): authoritative keys are both, derivable ones neither, others captured only."""
    class_ = F.col("classification")
    captured = F.lit(capture) & (class_ != DERIVABLE)
    by = F.when(F.col("source") == HUMAN, "decided").otherwise("matched")
    why = F.when(F.lit(not capture), "capture_off").when(class_ == UNCLASSIFIED, "undecided").otherwise(F.concat_ws("_", class_, by))
    return rows.withColumn("captured", captured).withColumn("restored", class_ == AUTHORITATIVE).withColumn("why", why)


def profile(decisions: DataFrame, label: str = "", human_only: bool = True) -> DataFrame:
    """Decisions as rows of a profile that another site can take over: version, label, pattern, classification."""
    rows = decisions.where(F.col("source") == HUMAN) if human_only else decisions
    return rows.where(F.trim("pattern") != "").select(F.lit(PROFILE_VERSION).alias("version"), F.lit(label).alias("label"), "pattern", "classification")


def applied(decisions: DataFrame, taken: DataFrame, overwrite: bool = False) -> DataFrame:
    """(pattern, classification, source, applied) after a profile was applied: its decisions count as a person's here.

    What a person decided here stays unless overwrite. Rows of another version or with an unknown class aren't taken. applied: whether
    the profile's row was; false: it was kept back; null: the pattern isn't in the profile.
    """
    known = taken.where((F.col("version") == PROFILE_VERSION) & F.col("classification").isin(AUTHORITATIVE, DERIVABLE, UNCLASSIFIED))
    theirs = known.groupBy("pattern").agg(F.max("classification").alias("_theirs"))
    rows = decisions.join(theirs, "pattern", "full_outer")
    here = (F.col("source") == HUMAN).eqNullSafe(True)
    take = F.when(F.col("_theirs").isNotNull(), F.lit(overwrite) | ~here)
    return rows.select("pattern", F.when(take, F.col("_theirs")).otherwise(F.col("classification")).alias("classification"), F.when(take, HUMAN).otherwise(F.col("source")).alias("source"), take.alias("applied"))
