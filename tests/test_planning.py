"""Plans, capture, chains and reachability against plain versions over small random inputs, and edge cases."""

import itertools
import random

import pytest
from annalist.operators import capture, graph, history, planning, policy, store
from annalist.plans.staging import staged
from pyspark.sql import functions as F

from test_history import OPS


def merged(base, ours, theirs):
    """Outcome of one object, each side a dict or None."""
    if ours is None and theirs is None:
        return "unchanged"
    if theirs is None:
        return "theirs" if base is not None and base == ours else "conflict"
    if ours is None:
        return "ours" if base is not None and base == theirs else "theirs" if base is None else "conflict"
    if base is None and ours != theirs:
        return "conflict"
    base, mine, other, clash = base or {}, 0, 0, 0
    for k in {*ours, *theirs}:
        a, b = ours.get(k, "-") != base.get(k, "-"), theirs.get(k, "-") != base.get(k, "-")
        clash += a and b and ours.get(k, "-") != theirs.get(k, "-")
        mine += a and not b
        other += b and not a
    return "conflict" if clash else {(False, False): "unchanged", (True, False): "ours", (False, True): "theirs", (True, True): "merged"}[mine > 0, other > 0]


def test_merge_objects_is_the_plain_three_way_merge(spark):
    r = random.Random(5)
    side = lambda: None if r.random() < 0.25 else {k: r.choice("xy") for k in "abc" if r.random() < 0.7} or None
    cases = {f"o{i}": (side(), side(), side()) for i in range(300)}
    cases |= {f"s{i}": (b, dict(b), dict(b, a="z")) for i, b in enumerate([{"a": "x", "b": None}, {"b": "y"}])}
    frames = [spark.createDataFrame([(o, k, v) for o, sides in cases.items() for k, v in (sides[n] or {}).items()], "object string, field string, value string") for n in range(3)]
    got = {row["object"]: row for row in planning.merge_objects(*frames).collect()}
    for o, sides in cases.items():
        if any(sides):
            assert got[o]["outcome"] == merged(*sides), (o, sides)
            assert (got[o]["conflicts"] > 0) == (got[o]["outcome"] == "conflict") and got[o]["resolved"] == (got[o]["outcome"] != "conflict")
    assert planning.merge_objects(*[f.limit(0) for f in frames]).count() == 0


def test_restore_plan_of_odd_rows(spark):
    rows = [(1, 1, "entity", "a", "create", 0, "f", '"1"', 1, True), (2, 2, "entity", "a", "update", 0, "f", None, 1, None), (3, 3, "entity", "b", "delete", 0, "f", None, 1, True),
            (4, 4, "ephemeral", "c", "create", 0, "f", '"1"', 1, True), (5, 5, None, "d", "create", 0, "f", '"1"', 1, True), (6, 6, "entity", "e", "update", 0, "f", '"2"', 1, False), (9, 9, "entity", "z", "create", 0, "f", '"2"', 1, True)]
    ops = spark.createDataFrame(rows, OPS + ", readable boolean")
    plan = planning.restore_plan(ops, 6)
    got = {r["subject"]: (r["exists"], r["status"], r["writable"], r["skipped"]) for r in plan.collect()}
    assert got == {"a": (True, "restorable", True, None), "d": (True, "restorable", True, None), "e": (False, "unrestorable", False, "nothing_usable")}
    assert [r["n"] for r in planning.counted(plan.limit(0), "status", planning.STATUSES).collect()] == [0, 0, 0]
    assert planning.concurrent_changes(plan, ops, 0).select("subject", "changed_at").collect() == [("a", 2)]
    named = spark.createDataFrame([("entity", "b"), ("entity", "none"), ("ephemeral", "c"), (None, "d"), ("entity", "z")], "realm string, subject string")
    got = {r["subject"]: (r["exists"], r["versions"], r["status"], r["skipped"]) for r in planning.restore_plan(ops, 6, named=named).collect()}
    nothing = (False, 0, "unrestorable", "nothing_usable")
    assert got == {"b": (False, 1, "restorable", None), "none": nothing, "c": (False, 0, "unrestorable", "realm_not_restored"), "d": (True, 1, "restorable", None), "z": nothing}


@pytest.mark.parametrize("seed", range(3))
def test_restore_plan_replays_operation_by_operation(spark, seed):
    r = random.Random(seed)
    rows = [(i, i, "entity", f"s{r.randrange(12)}", r.choice(["create", "update", "update", "delete", "truncate"]), 0, "f", r.choice(['"1"', None]), 1, r.choice([True, True, False, None])) for i in range(120)]
    state = {}
    for i, _, realm, subject, verb, _, _, payload, _, readable in rows:
        if i > 100:
            break
        exists, versions, lost, _ = state.get((realm, subject), (False, 0, 0, None))
        if verb in ("delete", "truncate"):
            state[realm, subject] = (False, versions + 1, lost, verb)
        elif payload is None:
            state[realm, subject] = (True, versions, lost, verb)
        elif readable:
            state[realm, subject] = (True, versions + 1, lost, verb)
        else:
            state[realm, subject] = (exists, versions, lost + 1, verb)
    plan = planning.restore_plan(spark.createDataFrame(rows, OPS + ", readable boolean"), 100, commit="microtime").collect()
    assert {(p["realm"], p["subject"]): (p["exists"], p["versions"], p["unreadable"]) for p in plan} == {k: v[:3] for k, v in state.items() if v[3] != "delete"}
    for p in plan:
        assert p["status"] == ("unrestorable" if not p["versions"] else "degraded" if p["unreadable"] else "restorable") and p["depth"] == 101


def test_merge_of_a_branch_that_is_merged_already(spark):
    rows = [(i, i, "config", f"s{i}", "create", 0, "f", '"1"', 1, i) for i in range(6)]
    ops = spark.createDataFrame(rows, OPS + ", commit_no long")
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 6)], "child long, parent long")
    assert planning.merge_plan(ops, planning.branch_sets(edges, 5, 2)).count() == 0
    assert {r["object"] for r in planning.merge_plan(ops, planning.branch_sets(edges, 2, 5)).collect()} == {"s3", "s4", "s5"}


def test_holds_by_whole_and_short_names(spark):
    findings = spark.createDataFrame([("x", "abcdefghij", "quarantine", None), ("y", "abc", "quarantine", None), ("z", None, "quarantine", None), ("w", "q" * 10, "quarantine", 5)], "code string, scope string, rung string, resolved long")
    targets = spark.createDataFrame([("abcdefgh",), ("abcdefg",), ("abc",), ("abcdefghij",), ("q" * 10,), ("abcdefghX",)], "target string")
    assert {r["target"]: r["quarantined_by"] for r in planning.restore_holds(targets, findings).where("held").collect()} == {"abcdefgh": "x", "abcdefghij": "x", "abc": "y"}
    refuse = findings.union(spark.createDataFrame([("r", "any", "refuse", None)], findings.schema))
    assert planning.restore_holds(targets, refuse).where("held").count() == 6


def test_row_changes(spark):
    rows = [(1, 1, "a", "x", "t1", "5"), (1, 2, "a", None, "t2", "5"), (1, 3, "a", None, "t3", "6"), (1, 4, "a", None, "t4", "6"), (None, 1, "b", "", "t", None)]
    got = capture.row_changes(spark.createDataFrame(rows, "id long, v long, name string, body string, changed string, access string"), ["id"], ["v"], ["name", "body", "changed", "access"], access=("access",)).collect()
    seen = {(r["id"], r["v"]): (r["verb"], r["changed"], r["touch"]) for r in got}
    assert seen == {(1, 1): ("create", ["name", "body"], False), (1, 2): ("update", ["body"], False), (1, 3): ("update", [], True), (1, 4): ("update", [], False), (None, 1): ("create", ["name", "body"], False)}
    assert next(r["payload"] for r in got if r["v"] == 2) == {"body": None}


def test_key_writes_and_scope(spark):
    writes = spark.createDataFrame([("k", 1, None), ("k", 2, "a"), ("k", 3, "b"), ("k", 4, None), ("k", 5, "c")], "key string, n long, value string")
    assert [r["verb"] for r in capture.key_writes(writes, ["key"], ["n"], "value").orderBy("n").collect()] == ["delete", "create", "update", "delete", "create"]
    ops = spark.createDataFrame([("entity", "own:1"), ("entity", "node:1"), ("table", "cache_x:1"), ("table", "cachetags"), ("table", "mine_a:2"), ("table", "users:3"), (None, "users:3"), ("file", "f")], "realm string, subject string")
    assert [r["subject"] for r in ops.where(capture.in_scope(("entity", "table"), ("own",), "mine_")).collect()] == ["node:1", "users:3"]


def test_chain_depths_and_pointers_send_no_table_through_the_driver(spark, monkeypatch):
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df)

    monkeypatch.setattr(graph, "staged", kept)
    frames = spark.range(200).select(F.col("id").alias("hash"), F.when(F.col("id") % 20 > 0, F.col("id") - 1).alias("parent"))
    assert graph.reanchor(frames, 12).where("before > 12 and after = 0").count() == 70
    assert graph.follow(spark.createDataFrame([(0, 0)], "node long, depth long"), frames.where("parent is not null").select(F.col("parent").alias("node"), F.col("hash").alias("up"))).count() == 20
    assert len(plans) > 8 and any("SortMergeJoin" in p for p in plans)
    # only the list of frames to write anew, of at most `budget` rows, may be sent
    assert sum("BroadcastExchange" in p for p in plans) <= 1


@pytest.mark.parametrize("seed", [1, 2])
def test_chain_depths_and_reanchoring(spark, seed):
    r = random.Random(seed)
    parent = {n: (None if n == 0 or r.random() < 0.05 else r.randrange(max(0, n - 3), n)) for n in range(300)} | {900: 5000, 901: 900}

    def depth(n, links):
        return 0 if links[n] is None or links[n] not in links else 1 + depth(links[n], links)

    frames = spark.createDataFrame(list(parent.items()), "hash long, parent long")
    before = {n: depth(n, parent) for n in parent}
    assert {x["hash"]: x["depth"] for x in graph.chain_depths(frames).collect()} == before
    alone = sorted((n for n in parent if before[n] > 4), key=lambda n: (-before[n], n))[:50]
    after = {n: (None if n in alone else p) for n, p in parent.items()}
    assert {x["hash"]: (x["before"], x["after"]) for x in graph.reanchor(frames, 4, 50).collect()} == {n: (before[n], depth(n, after)) for n in parent if before[n] > 0}
    assert graph.chain_depths(frames.limit(0)).count() == 0


def test_chains_in_a_circle_are_an_error(spark):
    with pytest.raises(ValueError):
        graph.chain_depths(spark.createDataFrame([(1, 2), (2, 1)], "hash long, parent long"))


def test_anchors_due_is_the_plain_walk(spark):
    r = random.Random(3)
    rows = {h: sorted({r.randrange(10**6) * 1_000_000 for _ in range(200)}) for h in "ab"}
    wanted = []
    for h, times in rows.items():
        last, n = None, 0
        for t in times:
            if last is None or t - last >= 14_400 * 1_000_000:
                wanted.append((h, t, n, n % 24 == 0))
                last, n = t, n + 1
    commits = spark.createDataFrame([(h, t) for h, times in rows.items() for t in itertools.chain(times, times[:3])], "history string, microtime long")
    assert sorted(tuple(x) for x in graph.anchors_due(commits).collect()) == sorted(wanted)


def test_capacity_halves_like_a_loop(spark):
    df = spark.createDataFrame([(0,), (1,), (7,), (12_345,), (99_999_999,), (10**9,)], "most long")

    def plain(most, low=1, high=100_000_000):
        if most < 1:
            return 0
        if most >= high:
            return high
        for _ in range(24):
            if high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if middle <= most else (low, middle)
        return low

    for row in df.withColumn("n", policy.capacity(lambda u: u <= F.col("most"))).collect():
        assert row["n"] == plain(row["most"])


def test_media_of_any_size_come_back(spark):
    docs = [(1, None), (2, ""), (3, "x" * 16), (4, "é" * 33), (5, "y" * 15)]
    blocks = store.cut(spark.createDataFrame(docs, "id long, body string"), "id", "body", 16)
    assert {r["id"]: bytes(r["body"]) for r in store.reassemble(blocks, "id").collect()} == {i: (b or "").encode() for i, b in docs}


def test_replay_of_a_merge_side_is_by_commit(spark):
    ops = spark.createDataFrame([(1, 1, "config", "c", "create", 0, "a", "1", 1, 0), (2, 2, "config", "c", "update", 0, "a", "2", 1, 1), (3, 3, "config", "c", "update", 0, "b", "9", 1, 2), (4, 4, "file", "p", "update", 0, "b", "9", 1, 2)], OPS + ", commit_no long")
    edges = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "child long, parent long, side int")
    sets = planning.branch_sets(edges, 1, 2)
    assert [tuple(r) for r in planning.merge_plan(ops, sets).collect()] == [("c", "merged", 0, 1, 1, True)]
    assert [(r["realm"], r["subjects"], r["named"], r["more"]) for r in planning.merge_refusals(ops, sets).collect()] == [("file", 1, ["p"], 0)]
    with pytest.raises(ValueError):
        planning.branch_sets(edges, 1, 7)
    assert history.replay(ops).count() == 3
