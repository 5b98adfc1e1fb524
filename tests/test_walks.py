"""Walks, cycles, numbering and archive closures against plain versions."""

import random
from collections import deque

import pytest
from annalist.operators import archive, graph, ranges, walks
from pyspark.sql import Window
from pyspark.sql import functions as F


def plain_steps(edges, seed):
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    depth, queue = {seed: 0}, deque([seed])
    while queue:
        x = queue.popleft()
        for y in near.get(x, ()):
            if y not in depth:
                depth[y] = depth[x] + 1
                queue.append(y)
    return depth


def plain_loops(edges):
    reach = {}
    for x in {x for e in edges for x in e}:
        reach[x] = set().union(*[plain_steps(edges, b) for a, b in edges if a == x], set())
    return {x: min(y for y in r if x in reach[y]) for x, r in reach.items() if x in r}


def history(kind, rng, n=200, low=1 << 60):
    edges = [(i, i - 1) for i in range(1, n)]
    if kind == "merges":
        edges += [(i, i - 3) for i in range(10, n, 10)]
    if kind == "branches":
        edges = [(i, max(0, i - rng.choice([1, 2, 2, 5, 40]))) for i in range(1, n)] + [(i, max(0, i - rng.randrange(2, 60))) for i in range(10, n, 7)]
    if kind == "loops":
        edges += [(i, max(0, i - rng.randrange(2, 60))) for i in range(10, n, 7)] + [(20, 25), (100, 160), (120, 121), (7, 7)]
    if kind == "anywhere":
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(1.2 * n))]
    return [(a + low, b + low) for a, b in edges]


@pytest.mark.parametrize("kind", ["line", "merges", "branches", "loops", "anywhere"])
def test_walks_and_cycles(spark, kind):
    edges = history(kind, random.Random(kind))
    df = spark.createDataFrame([*edges, edges[0]], "child long, parent long")
    found = walks.levels(df, 24)
    assert len(found) > 1 or kind not in ("line", "merges")
    low = 1 << 60
    seeds = [("a", low + 199), ("b", low + 90), ("b", low + 30), ("c", low + 5000)]
    got = {(r.label, r.node): r.depth for r in walks.reached(found, spark.createDataFrame(seeds, "label string, node long")).collect()}
    wanted = {}
    for label, seed in seeds:
        for node, d in plain_steps(edges, seed).items():
            wanted[label, node] = min(d, wanted.get((label, node), d))
    assert got == wanted
    assert {r.node: r.loop for r in walks.cycles(df, found=found).collect()} == plain_loops(edges)


def test_empty_graph(spark):
    none = spark.createDataFrame([], "child long, parent long")
    seeds = spark.createDataFrame([(0, 5)], "label int, node long")
    assert [(r.node, r.depth) for r in walks.reached(walks.levels(none), seeds).collect()] == [(5, 0)]
    assert walks.cycles(none).collect() == []


def test_a_long_line_takes_few_levels(spark):
    n = 60_000
    found = walks.levels(spark.range(1, n).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent")))
    assert len(found) == 2
    out = walks.reached(found, spark.createDataFrame([(0, n - 1)], "label int, node long"))
    assert out.count() == n and out.where(F.col("depth") != n - 1 - F.col("node")).count() == 0


def test_numbers_without_gaps(spark):
    rows = [(random.Random(i).randrange(50), i) for i in range(1000)]
    got = ranges.running(spark.createDataFrame(rows, "k long, i long"), ["k", "i"], {"n": "cast(1 as bigint)", "total": "i"}, parts=7).collect()
    total = 0
    for n, (k, i) in enumerate(sorted(rows), 1):
        total += i
        rows[n - 1] = (k, i, n, total)
    assert sorted((r.k, r.i, r.n, r.total) for r in got) == sorted(rows)
    assert ranges.numbered(spark.createDataFrame([], "k long"), "k").collect() == []


def test_prune_gate(spark):
    commits = spark.createDataFrame([(i,) for i in range(10)], "commit_no long")
    gate = lambda edges, refs, **more: graph.prune_gate(spark.createDataFrame(edges, "child long, parent long"), commits, spark.createDataFrame([(r,) for r in refs], "node long"), **more).first().asDict()
    line = [(i, i - 1) for i in range(1, 10)]
    assert gate(line, [9]) == {"reached": 10, "missing_commits": 0, "looping_commits": 0, "unreadable": 0, "refuse": False, "reason": None}
    assert gate([*line, (0, -1)], [5])["reason"] == "commits.missing"
    looped = gate([*line, (2, 4)], [9])
    assert looped["looping_commits"] == 3 and looped["reason"] == "commits.loop" and looped["refuse"]
    assert gate([*line, (8, 9)], [3])["refuse"] is False  # a loop that no ref leads to
    kinds = "kind string, id long"
    unread = gate(line, [9], live=spark.createDataFrame([("frame", 1), ("commit", 99)], kinds), present=spark.createDataFrame([("frame", 2)], kinds))
    assert unread["unreadable"] == 1 and unread["reason"] == "objects.unreadable"
    assert gate([(1, 0)], [])["reached"] == 0


def plain_newest(first, merged, there, head, limit):
    out, missing, seen, tips = [], set(), set(), [head]
    while tips and (limit is None or len(out) < limit):
        node = tips.pop(0)
        while node is not None and node not in seen:
            if node not in there:
                missing.add(node)
                break
            seen.add(node)
            out.append(node)
            tips += merged.get(node, [])
            if limit is not None and len(out) >= limit:
                break
            node = first.get(node)
    return out, missing


@pytest.mark.parametrize("seed", range(4))
def test_newest_commits(spark, seed):
    rng = random.Random(seed)
    n = 60
    first = {i: i - rng.choice([1, 1, 1, 2, 3]) for i in range(3, n)}
    merged = {i: [rng.randrange(i)] for i in rng.sample(range(5, n), 14)}
    there = set(range(n)) - set(rng.sample(range(1, n - 5), 3))
    rows = [(c, p, 0, c in there) for c, p in first.items()] + [(c, p, 1, c in there) for c, ps in merged.items() for p in ps] + [(c, None, 0, c in there) for c in range(3)]
    edges = spark.createDataFrame(rows, "child long, parent long, side int, present boolean")
    for limit in (None, 1, 17, 40):
        got = archive.newest_commits(edges, n - 1, limit).collect()
        out, missing = plain_newest(first, merged, there, n - 1, limit)
        assert [r.commit_no for r in sorted((r for r in got if not r.missing), key=lambda r: r.number)] == out
        assert sorted(r.number for r in got if not r.missing) == list(range(len(out)))
        assert {r.commit_no for r in got if r.missing} == missing


def test_closure_names_what_is_missing(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    commits = make([(0, 9, False), (1, 8, False), (None, 7, True)], "number long, commit_no long, missing boolean")
    segments = make([(9, "s9", True), (8, "s8", False), (1, "s1", True)], "commit_no long, segment string, readable boolean")
    anchors = make([(9, "b"), (8, "d"), (1, "z")], "commit_no long, anchor string")
    parents = make([("b", "a"), ("a", None), ("d", "c"), ("z", None)], "child string, parent string")
    names = make([("segment", "s9", 1), ("segment", "s8", 2), ("anchor", "a", 3), ("anchor", "d", 4), ("segment", "s1", 5)], "kind string, owner string, frame long")
    frames = make([(1, "p1", 10, "x"), (10, None, 11, "y"), (3, "p1", None, None), (4, "p2", None, None)], "frame long, pack string, parent long, dictionary string")
    got = {(r.part, r.key if r.part == "object" else f"{r.key} {r.id}") for r in archive.closure(commits, segments, anchors, parents, names, frames, make([("x",)], "dictionary string")).collect()}
    objects = {"commits/9", "commits/8", "segments/s9", "segments/s8", "anchors/a", "anchors/b", "packs/p1", "frames/10", "dictionaries/x", "refs/main"}
    problems = {"chain.ended 7", "segment.unreadable s8", "anchor.unwalkable d", "frame.unindexed 11", "dictionary.unindexed y"}
    assert got == {("object", o) for o in objects} | {("problem", p) for p in problems}


def test_blocks_overlap_by_what_a_window_reaches(spark):
    rows = [(i, i * i % 97) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, v long").repartition(5)
    w = Window.partitionBy("_block").orderBy("i").rowsBetween(-20, -1)
    got = ranges.overlapping(df, ["i"], 20, 32).withColumn("s", F.sum("v").over(w)).where("_own").select("i", "s").collect()
    assert {(r.i, r.s) for r in got} == {(i, sum(v for _, v in rows[max(0, i - 20) : i]) if i else None) for i in range(300)}
