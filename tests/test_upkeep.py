"""Keys, settings, records, estimates and wires in small cases."""

import re

import pytest
from annalist.functions import text as tx
from annalist.operators import keyspace, policy, quality, records
from annalist.plans.upkeep import QUERIES
from pyspark.sql import functions as F


def plain_redacted(text):
    out = ""
    for line in re.split(r"(\r\n|\n|\r)", text):
        at = line.find("=>") if "=>" in line else line.find("=")
        target = line[:at].lower()
        names = "$" in target or re.search(r"""['"][a-z0-9_.\-]+['"]\s*$""", target)
        if at >= 0 and names and any(s in target for s in tx.SECRETS):
            rest = line[at:]
            line = line[:at] + ("=>" if "=>" in line else "=") + f" '{tx.MARKER}'" + (";" if ";" in rest else "," if "," in rest else "")
        out += line
    return out


def test_settings_are_redacted_line_by_line(spark):
    files = [
        "$databases['default']['password'] = 'x';\r\n$a = 1;\r  'hash_salt' => 'y',\n\n# token = z\n$settings['API_KEY']='q'\n'plain' => 1;",
        "if ($token == 1) { $x = 2, 3; }\n$port = 3306;\n\"smtp_pass\"=>\"a=b\"\n=\n=> 3\npassword = 'no variable'",
        "", "no assignment", "$secret=", "\r\r\n\n", "$dsn\n= 1", "'AWS_SECRET' => [\n'k' => 1,\n],", "$päss = 1;\n$pässword=2;\n'sälz salt' => 4",
    ]
    df = spark.createDataFrame(list(enumerate(files)), "i int, t string")
    rows = df.select("i", tx.redact_settings(F.col("t")).alias("r"), tx.secret_lines(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.r for r in rows] == [plain_redacted(t) for t in files]
    assert [r.n for r in rows][:4] == [3, 2, 0, 0]
    assert df.limit(1).select(tx.redact_settings(F.lit(None).cast("string"))).first()[0] is None


def test_settings_are_dealt_to_tasks_beyond_the_scan(spark, sf_dir):
    assert QUERIES["redacted_settings"](spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_sites_and_labels(spark):
    row = spark.range(1).select(tx.site_id(F.lit(" a b/c! "), F.lit("x")), tx.site_id(F.lit("!"), F.lit("db"), F.lit(None), F.lit("host")), tx.site_key(F.lit("s"), F.lit("//k/x")), tx.own_key(F.lit("s"), F.lit("s/k")), tx.own_key(F.lit("s"), F.lit("st/k")), tx.label("outcome", F.lit("ours")), tx.label("realm", F.lit("?"))).first()
    import hashlib

    assert tuple(row) == ("abc", hashlib.sha256(b"db||host").hexdigest()[:12], "s/k/x", "k", None, "Kept", None)


def test_rules_are_asked_in_order(spark):
    keys = ["key_value_expire.a", "keyvalue.x", " CACHE:a ", "my_cache", "x.queue", "x.queue.y", "blob:1", "", None, ":x", "a.expire", "config\nx", "lock"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    decided = spark.createDataFrame([("blob*", "authoritative", "human"), ("cache*", "authoritative", "heuristic"), ("lock*", "unclassified", "human")], "pattern string, classification string, source string")
    got = {r.key: (r.namespace, r.pattern, r.classification, r.source) for r in keyspace.classified(df, decided).collect()}
    rule, human = keyspace.RULE, keyspace.HUMAN
    assert got == {
        "key_value_expire.a": ("key_value_expire", "key_value_expire*", "derivable", rule), "keyvalue.x": ("keyvalue", "keyvalue*", "authoritative", rule), " CACHE:a ": ("cache", "cache*", "derivable", rule),
        "my_cache": ("my_cache", "*_cache", "derivable", rule), "x.queue": ("x", "*.queue", "authoritative", rule), "x.queue.y": ("x", "x*", "unclassified", None), "blob:1": ("blob", "blob*", "authoritative", human),
        "": ("", "*", "unclassified", None), None: ("", "*", "unclassified", None), ":x": ("", "*", "unclassified", None), "a.expire": ("a", "*.expire", "derivable", rule), "config\nx": ("config\nx", "config*", "derivable", rule), "lock": ("lock", "lock*", "unclassified", human),
    }
    off = keyspace.explained(keyspace.classified(df, decided), capture=False)
    assert {r.why for r in off.collect()} == {"capture_off"} and not off.where("captured").count()
    on = {r.key: (r.captured, r.restored, r.why) for r in keyspace.explained(keyspace.classified(df, decided)).collect()}
    assert on["blob:1"] == (True, True, "authoritative_decided") and on["my_cache"] == (False, False, "derivable_matched") and on["lock"] == (True, False, "undecided")


def test_profiles_leave_own_decisions_alone(spark):
    mine = spark.createDataFrame([("a*", "derivable", "human"), ("b*", "derivable", "heuristic"), ("c*", "authoritative", "human"), (" ", "derivable", "human")], "pattern string, classification string, source string")
    profile = keyspace.profile(mine, "x")
    assert {tuple(r) for r in profile.collect()} == {(1, "x", "a*", "derivable"), (1, "x", "c*", "authoritative")}
    taken = spark.createDataFrame([("a*", "authoritative", 1), ("b*", "authoritative", 1), ("d*", "derivable", 1), ("e*", "odd", 1), ("f*", "derivable", 2)], "pattern string, classification string, version int")
    row = lambda df: {(r.pattern, r.classification, r.source, r.applied) for r in df.collect() if r.pattern.strip()}
    kept = {("c*", "authoritative", "human", None), ("b*", "authoritative", "human", True), ("d*", "derivable", "human", True)}
    assert row(keyspace.applied(mine, taken)) == kept | {("a*", "derivable", "human", False)}
    assert row(keyspace.applied(mine, taken, overwrite=True)) == kept | {("a*", "authoritative", "human", True)}


def test_branches_follow_their_requests(spark):
    c = "a" * 64
    rows = [(1, "create", "x", c), (2, "create", "x", "b" * 64), (3, "delete", "x", None), (4, "delete", "x", None), (5, "create", "x", "short"), (6, "create", "x", "c" * 64), (7, "create", "main", c), (8, "delete", "main", None),
            (9, "create", "a//b", c), (10, "create", "A", c), (11, "create", None, c), (12, "move", "x", c), (13, None, "x", c), (14, "create", "y/z", c), (15, "delete", "y/z", None), (16, "create", "n" * 129, c), (17, "create", "n" * 128, c)]
    q = spark.createDataFrame([(*r, 7, r[0] * 10) for r in rows], "number long, action string, name string, commit string, actor long, at long")
    got = [r.result for r in sorted(records.branch_requests(q).collect(), key=lambda r: r.number)]
    assert got == ["created", "exists", "deleted", "absent", "bad_commit", "created", "trunk", "trunk", "bad_name", "bad_name", "bad_name", "unknown", "unknown", "created", "deleted", "bad_name", "created"]
    there = records.branch_tips(records.branches(q), spark.createDataFrame([("c" * 64,)], "commit string"))
    assert {(r.name[:2], r.ref[:7], r.tip[0], r.created, r.lost) for r in there.collect()} == {("x", "heads/x", "c", 60, False), ("nn", "heads/n", "a", 170, True)}
    assert records.branches(q.limit(0)).collect() == []


def test_audit_and_drills(spark):
    opens = spark.createDataFrame([(1, 10, 5, "t", "s", "x" * 300, "logical", 2), (2, 20, None, "t", None, "y", "physical", 3)], "id long, started long, actor long, target string, pre_snapshot string, scope string, mode string, skipped long")
    closes = spark.createDataFrame([(1, 15, "failed", 0, 9), (1, 18, "succeeded", 4, 1), (77, 1, "succeeded", 1, 1)], "id long, finished long, outcome string, restored long, skipped long")
    refused = spark.createDataFrame([(3, 30, 1, "t", "z", "logical", 6)], "id long, started long, actor long, target string, scope string, mode string, subjects long")
    got = {r.id: (r.finished, r.outcome, r.restored, r.skipped, len(r.scope)) for r in records.audit(opens, closes, refused).collect()}
    assert got == {1: (18, "succeeded", 4, 1, 255), 2: (None, "pending", 0, 3, 1), 3: (30, "refused", 0, 6, 1)}
    drills = spark.createDataFrame([(i, i // 2, "passed" if i % 3 else "failed") for i in range(20)], "id long, created long, verdict string")
    assert [r.id for r in records.recent(drills, "created", 3).collect()] == [19, 18, 17] and records.recent(drills, "created", 0).count() == 1
    assert {r.verdict: r.n for r in records.verdicts(drills, 6).collect()} == {"passed": 4, "failed": 2, "inconclusive": 0, "refused": 0}


def test_estimates_and_classes(spark):
    sites = spark.createDataFrame([(0, 10.0, 14400, 15, 365, 12, None), (1000, 0.0, 14400, 15, 365, 0, 0.5), (200_000, 50_000.0, 14400, 15, 365, 26, 7.5)], "subjects long, ops_per_day double, base_interval long, segment_interval long, retention_days long, deploys_per_year long, measured_ratio double")
    got = policy.estimate(sites).collect()
    assert [r.tree_bytes for r in got[:2]] == [0, 0] and [r.ratio for r in got] == [5.86, 1.0, 7.5]
    writes, n = round(50_000 * 14400 / 86400), 200_000
    assert abs(got[2].tree_bytes - round(31_557_600 / 14400) * 365 / 365.25 * n * (1 - (1 - 1 / n) ** writes) * 240) < 1000
    assert got[2].writes_per_month == round(round(2_629_800 / 15) * 4 * 1.05) and got[2].code_bytes == round(26 * 365 / 365.25 * 62_772)
    row = spark.range(1).select(policy.storage_class(F.lit(True)), policy.storage_class(F.lit(False)), policy.storage_class(F.lit(True), tier_blocks=False), policy.storage_class(F.lit(True), block_class=" COLD "), policy.storage_class(F.lit(None).cast("boolean"))).first()
    assert tuple(row) == ("STANDARD_IA", None, None, "COLD", None)


def test_columns_of_tables_and_wires(spark):
    assert [quality.order_column(c) for c in (["x", "id"], ["userid", "nid", "bid"], ["a", "name"], ["a", "b"], [])] == ["id", "bid", "name", "a", None]
    assert quality.changed_column(["created", "changed"]) == "changed" and quality.changed_column(["x"]) is None
    found = spark.createDataFrame([("frame.missing", "1"), ("ref.missing", "main")], "code string, scope string")
    other = dict.fromkeys(("short_packs", "unreachable_tiers", "shifted_files", "drifted_tables", "drifted_files", "total_keys", "unclassified", "lag_seconds"), 0)
    seen = quality.store_observation(found, rest=spark.createDataFrame([tuple(other.values())], ", ".join(f"{n} long" for n in other)))
    assert {r.code: r.rung for r in quality.tripwires(seen, quality.STORE_WIRES).collect()} == {"frame.missing": "quarantine", "ref.missing": "quarantine"}
    assert quality.tripwires(seen, quality.STORE_WIRES, whole=True).count() == 19


@pytest.mark.parametrize("pattern,key,fits", [("a*", "abc", True), ("*.x", "y.x", True), ("*.x", "yzx", False), ("a.b", "aXb", False), ("(a)", "(a)", True)])
def test_globs(pattern, key, fits):
    assert bool(re.match(keyspace.glob(pattern), key)) is fits
