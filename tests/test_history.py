"""Log operators against plain folds over random histories, and edge cases."""

import random

import pytest
from annalist.operators import coding, flush, graph, history, policy, quality, store, timeline
from pyspark.sql import functions as F

OPS = "sequence long, microtime long, realm string, subject string, verb string, actor long, field string, field_json string, payload_length long"
PAIRS = {("create", "update"): "create", ("create", "delete"): None, ("create", "create"): "create", ("update", "update"): "update", ("update", "delete"): "delete",
         ("update", "create"): "update", ("delete", "create"): "update", ("delete", "update"): "update", ("delete", "delete"): "delete"}


def random_ops(seed, n=600, subjects=60, verbs=("create", "update", "delete")):
    r = random.Random(seed)
    return [(i, i * 1000, "entity", f"s{r.randrange(subjects)}", r.choice(verbs), 0, r.choice("abcd"), None if r.random() < 0.1 else f'"{i}"', 3) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_collapse_is_the_fold_of_pairs(spark, seed):
    rows = random_ops(seed)
    state = {}
    for o in rows:
        key = o[3]
        verb = state.get(key, o[4]) if key not in state else PAIRS[state[key], o[4]]
        if verb is None:
            del state[key]
        else:
            state[key] = verb
    got = {r["subject"]: r["verb"] for r in history.collapse(spark.createDataFrame(rows, OPS)).collect()}
    assert got == state


def test_barriers_end_runs(spark):
    rows = [(1, 1, "entity", "a", "create", 0, "f", '"1"', 1), (2, 2, "entity", "a", "rename", 0, "f", '"2"', 1), (3, 3, "entity", "a", "delete", 0, "f", '"3"', 1), (4, 4, "file", "p", "update", 0, "f", '"4"', 1)]
    got = sorted((r["first_sequence"], r["verb"]) for r in history.collapse(spark.createDataFrame(rows, OPS)).collect())
    assert got == [(1, "create"), (2, "rename"), (3, "delete"), (4, "update")]


def test_merged_payload_has_the_last_value_of_each_field(spark):
    rows = [(1, 1, "entity", "a", "update", 0, "x", '"1"', 1), (2, 2, "entity", "a", "update", 0, "y", '"2"', 1), (3, 3, "entity", "a", "update", 0, "x", '"3"', 1)]
    assert history.collapse(spark.createDataFrame(rows, OPS), payload="merge").first()["payload"] == '{"x":"\\"3\\"","y":"\\"2\\""}'


def test_replay_is_the_sequential_fold(spark):
    rows = random_ops(3)
    state = {}
    for o in rows:
        if o[4] == "delete":
            state = {k: v for k, v in state.items() if k[0] != o[3]}
        elif o[7] is not None:
            state[o[3], o[6]] = o[7]
    got = {(r["subject"], r["field"]): r["value"] for r in history.replay(spark.createDataFrame(rows, OPS)).collect()}
    assert got == state


def test_empty_journal(spark):
    empty = spark.createDataFrame([], OPS)
    for df in (history.collapse(empty), history.replay(empty), history.diff_subjects(empty, 1, 2), history.previous_version(empty), flush.flush_batches(empty)):
        assert df.count() == 0


def test_three_way_merge_cases(spark):
    side = lambda d: spark.createDataFrame([(k, v) for k, v in d.items()], "id string, value string")
    base, ours, theirs = side({"a": "1", "b": "1", "c": "1", "d": "1", "e": None}), side({"a": "1", "b": "2", "c": "2", "e": None}), side({"a": "2", "b": "2", "c": "3", "d": "1", "f": "9"})
    got = {r["id"]: (r["outcome"], r["present"], r["value"]) for r in history.merge_three_way(base, ours, theirs, ["id"]).collect()}
    assert got == {"a": ("theirs", True, "2"), "b": ("both", True, "2"), "c": ("conflict", True, "1"), "d": ("ours", False, None), "e": ("theirs", False, None), "f": ("theirs", True, "9")}


def test_statement_kinds(spark):
    texts = ["INSERT INTO `node` VALUES (1)", "/* x */ update {users} set a = 1", "delete from t where 1", "select 1", "TRUNCATE TABLE cache", "create table if not exists q (a int)", None]
    got = [(r["verb"], r["target"]) for r in history.statement_kinds(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, statement string")).orderBy("i").collect()]
    assert got == [("create", "node"), ("update", "users"), ("delete", "t"), (None, None), ("truncate", "cache"), ("ddl", "q"), (None, None)]


def test_reachability_of_diamonds(spark):
    edges = spark.createDataFrame([(4, 3, 0), (4, 2, 1), (3, 1, 0), (2, 1, 0), (9, 8, 0)], "child long, parent long, side int")
    got = {r["node"]: r["depth"] for r in graph.reachable(edges, spark.createDataFrame([(4,)], "node long")).collect()}
    assert got == {4: 0, 3: 1, 2: 1, 1: 2}
    assert graph.merge_base(edges, 3, 2).first()["commit_no"] == 1


@pytest.mark.parametrize("span, width", [(0, 1), (10, 1), (480, 1), (481, 5), (3600, 15), (86_400, 300), (604_800, 3600), (31_536_000, 86_400), (315_360_000, 604_800)])
def test_resolution_ladder(span, width):
    assert timeline.resolution(span) == width


def test_robust_score_of_a_jump(spark):
    df = spark.createDataFrame([(i, 10.0 + i % 3) for i in range(20)] + [(20, 500.0)], "t long, v double")
    rows = timeline.robust_scores(df, "t", "v").orderBy("t").collect()
    assert rows[3]["score"] is None and not rows[19]["anomalous"] and rows[20]["anomalous"]


def test_robust_score_without_spread(spark):
    """As shares of the median where nothing has spread, and the sign at median 0."""

    def last(values, **how):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "t long, v double")
        return timeline.robust_scores(df, "t", "v", **how).orderBy(F.desc("t")).first()

    assert last([5] * 10 + [10], floor=0.0)["score"] == 1.0 and not last([5] * 10 + [10], floor=0.0)["anomalous"]
    assert last([0] * 10 + [3])["score"] == 1.0 and last([0] * 10 + [-3])["score"] == -1.0 and last([0] * 10 + [0])["score"] == 0.0
    assert last([10, 11, 9, 10, 10, 11, 9, 10, 10, 90])["anomalous"] and not last([10, 11, 9, 10, 10, 11, 9, 10, 10, 90], fall_only=F.lit(True))["anomalous"]
    assert last([10, 11, 9, 10, 10, 11, 9, 10, 10, 1], fall_only=F.lit(True))["anomalous"]


def test_blocks_of_edge_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "ab" * 1024), (4, "é" * 700)], "id long, text string")
    got = {}
    for r in store.blocks(df, "id", "text", 1024).collect():
        got.setdefault(r["key"], []).append(r["length"])
    assert {k: sum(v) for k, v in got.items()} == {1: 0, 3: 2048, 4: 1400} and len(got[1]) == 1


def test_policy_edges(spark):
    rows = spark.createDataFrame([(0, 0), (5, 604_799), (6, 604_800), (7, 99_999_999)], "id long, age long").withColumn("t", policy.tier_for_age(F.col("age")))
    assert [r["t"] for r in rows.orderBy("id").collect()] == [0, 0, 1, 3]


def test_globs_and_circuit(spark):
    keys = spark.createDataFrame([("cache:a",), ("queue:error:1",), ("queue:x:1",), ("nothing",)], "key string")
    assert [r[0] for r in keys.select(quality.classify(F.col("key"))).collect()] == ["ephemeral", "durable", "transient", "unclassified"]
    c = spark.createDataFrame([(1, 0), (3, 10), (3, 400)], "f int, s int")
    assert [r[0] for r in c.select(quality.circuit_state(F.col("f"), F.col("s"))).collect()] == ["closed", "open", "half-open"]


def test_line_diff_and_delta(spark):
    pairs = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, None, "")], "id long, a string, b string")
    assert sorted((r["kind"], r["n_before"], r["n_after"]) for r in coding.line_diff(pairs, "id", "a", "b").collect()) == [("add", 0, 1), ("change", 1, 1)]
    v = spark.createDataFrame([(1, "hello world " * 20 + "tail", "hello world " * 20)], "id long, v string, p string")
    r = coding.delta_sizes(v, "id", "v", "p").first()
    assert r["kept"] == "delta" and r["delta"] < r["alone"]
