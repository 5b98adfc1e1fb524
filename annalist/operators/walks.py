"""Walks over long histories: fewest steps and cycles in rounds that grow with the logarithm of the history.

A history's nodes are dealt into blocks of neighbouring numbers. Inside a block, a task finds the steps from every node that an edge
from another block enters by to every edge that leaves; these make a smaller graph whose nodes are the entries only, and that is dealt
into blocks again until one block is left. A walk goes up through the levels (from the seeds to the entries they lead to) and down again
(from the entries to all nodes). A line of a million commits is two levels; merges add entries only where they cross a block's border.
Graphs whose edges lead anywhere don't get smaller so; these are short, and are walked in plain rounds, each written to the shared folder.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged
from .ranges import numbered

#: Nodes of a block, and how many times fewer entries than nodes there must be for another level.
BLOCK, SHRINK = 4096, 4


@dataclass
class Level:
    """Edges (child, parent, steps, block, far: the parent's block) and (node, block); blocks is None for a last level that is walked in rounds."""

    edges: DataFrame
    blocks: DataFrame | None


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()


def levels(edges: DataFrame, size: int = BLOCK) -> list[Level]:
    """The levels of a graph of edges (child, parent), to be shared by walks over it. Null ends are no edges; repeated edges count once."""
    now = edges.select("child", "parent", F.lit(1).cast("long").alias("steps")).where("child is not null and parent is not null").distinct()
    out: list[Level] = []
    while True:
        now = staged(now)
        nodes = staged(_nodes(now))
        n = nodes.count()
        if n <= size:
            blocks = nodes.withColumn("block", F.lit(0).cast("long"))
        else:
            blocks = staged(numbered(nodes, "node").select("node", F.expr(f"number div {size}").alias("block")))
        of = lambda end, name: blocks.select(F.col("node").alias(end), F.col("block").alias(name))
        dealt = now.join(of("child", "block"), "child").join(of("parent", "far"), "parent").select("child", "parent", "steps", "block", "far")
        if n <= size:
            return [*out, Level(dealt, blocks)]
        dealt = staged(dealt)
        entries = staged(dealt.where("block <> far").select(F.col("parent").alias("node"), F.col("far").alias("block")).distinct())
        if entries.count() * SHRINK > n:
            return [*out, Level(now, None)]
        out.append(Level(dealt, blocks))
        start = entries.select(F.col("node").alias("label"), "node", F.lit(0).cast("long").alias("depth"))
        now = spread(out[-1], start).where("beyond").groupBy(F.col("label").alias("child"), F.col("node").alias("parent")).agg(F.min("depth").alias("steps"))


def _table(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.Table:
    cols = zip(*rows) if rows else [()] * len(types)
    return pa.table([pa.array(c, t) for c, t in zip(cols, types.values())], names=list(types))


def _fewest(edges: dict, start: dict) -> dict:
    """Fewest steps to each node from nodes that have some already."""
    depth: dict = {}
    heap = [(d, n) for n, d in start.items()]
    heapq.heapify(heap)
    while heap:
        d, n = heapq.heappop(heap)
        if n not in depth:
            depth[n] = d
            for parent, steps in edges.get(n, ()):
                if parent not in depth:
                    heapq.heappush(heap, (d + steps, parent))
    return depth


def _in_blocks(level: Level, start: DataFrame) -> DataFrame:
    """The edges of the blocks that hold a start, and the starts, as one table dealt by block."""
    at = start.join(level.blocks, "node")
    needed = level.edges.join(at.select("block").distinct(), "block", "left_semi")
    none = lambda df, col: F.lit(None).cast(df.schema[col].dataType).alias(col)
    edges = needed.select("block", none(start, "label"), "child", "parent", "steps", (F.col("block") != F.col("far")).alias("leaves"))
    return edges.unionByName(at.select("block", "label", F.col("node").alias("child"), none(level.edges, "parent"), F.col("depth").alias("steps"), F.lit(None).cast("boolean").alias("leaves")))


def spread(level: Level, start: DataFrame) -> DataFrame:
    """(label, node, depth, beyond): what each label reaches from its starts (label, node, depth) without leaving a block, and where edges that leave lead."""
    label, node = (start.schema[c].dataType.simpleString() for c in ("label", "node"))

    def walk(rows: pa.Table) -> pa.Table:
        inside, leaving, starts, out = defaultdict(list), defaultdict(list), defaultdict(dict), []
        for who, child, parent, steps, leaves in zip(*[rows[c].to_pylist() for c in ("label", "child", "parent", "steps", "leaves")]):
            if leaves is None:
                starts[who][child] = min(steps, starts[who].get(child, steps))
            else:
                (leaving if leaves else inside)[child].append((parent, steps))
        for who, at in starts.items():
            depth, beyond = _fewest(inside, at), {}
            for child in depth.keys() & leaving.keys():
                for parent, steps in leaving[child]:
                    beyond[parent] = min(depth[child] + steps, beyond.get(parent, 1 << 62))
            out += [(who, n, d, far) for found, far in ((depth, False), (beyond, True)) for n, d in found.items()]
        return _table(out, {"label": rows["label"].type, "node": rows["child"].type, "depth": pa.int64(), "beyond": pa.bool_()})

    return _in_blocks(level, start).groupBy("block").applyInArrow(walk, f"label {label}, node {node}, depth long, beyond boolean")


def in_rounds(edges: DataFrame, start: DataFrame, limit: int = 100_000) -> DataFrame:
    """(label, node, depth) by plain rounds over edges (child, parent, steps): each joins what came nearer in the round before."""
    known = frontier = staged(start.groupBy("label", "node").agg(F.min("depth").alias("depth")))
    for _ in range(limit):
        found = frontier.join(edges, frontier["node"] == edges["child"]).groupBy("label", F.col("parent").alias("node")).agg(F.min(F.col("depth") + F.col("steps")).alias("depth"))
        frontier = staged(found.join(known.withColumnRenamed("depth", "_old"), ["label", "node"], "left").where("_old is null or depth < _old").drop("_old"))
        if not frontier.limit(1).count():
            return known
        known = staged(known.union(frontier).groupBy("label", "node").agg(F.min("depth").alias("depth")))
    raise ValueError(f"the walk wasn't at its end after {limit} rounds")


def reached(found: list[Level], seeds: DataFrame) -> DataFrame:
    """(label, node, depth): what each label reaches from its seeds (label, node; maybe depth, else 0), with the fewest steps.

    Seeds without edges are reached too.
    """
    least = lambda df: df.groupBy("label", "node").agg(F.min("depth").alias("depth"))
    start = seeds if "depth" in seeds.columns else seeds.withColumn("depth", F.lit(0).cast("long"))
    start = staged(least(start))
    ups = [start]
    for level in found[:-1]:
        ups.append(staged(least(spread(level, ups[-1]).where("beyond").drop("beyond"))))
    last = found[-1]
    inner = lambda level, at: spread(level, at).where("not beyond").drop("beyond").union(at)  # noqa: E731  # a level may lack edges of a start
    now = in_rounds(last.edges, ups[-1]) if last.blocks is None else staged(inner(last, ups[-1]))
    for level, up in reversed(list(zip(found[:-1], ups[:-1]))):
        now = staged(inner(level, up.union(now)))
    return least(now)


# --- cycles ---------------------------------------------------------------------------------------------------------


def _components(edges: dict[object, list]) -> Iterator[list]:
    """Strongly connected components with a cycle, by Tarjan's walk with a stack of its own."""
    order: dict = {}
    low: dict = {}
    path, on = [], set()
    for root in list(edges):
        if root in order:
            continue
        work = [(root, iter(edges.get(root, ())))]
        order[root] = low[root] = len(order)
        path.append(root)
        on.add(root)
        while work:
            node, more = work[-1]
            step = next(more, None)
            if step is not None:
                if step not in order:
                    order[step] = low[step] = len(order)
                    path.append(step)
                    on.add(step)
                    work.append((step, iter(edges.get(step, ()))))
                elif step in on:
                    low[node] = min(low[node], order[step])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[node])
            if low[node] == order[node]:
                some = []
                while not some or some[-1] != node:
                    some.append(path.pop())
                    on.discard(some[-1])
                if len(some) > 1 or node in edges.get(node, ()):
                    yield some


def _loops_within(level: Level, known: DataFrame | None, node: str) -> DataFrame:
    """(node, loop) of nodes in cycles, found in each block by itself.

    known: (node, loop) of entries that are in a cycle over several blocks. A cycle that leaves a block by an edge to such an entry comes
    back by any entry of that loop, so inside the block the loop is one more node.
    """
    inner = level.edges.select("block", "child", F.when(F.col("block") == F.col("far"), F.col("parent")).alias("parent"), F.lit(None).cast(node).alias("loop"))
    if known is not None:
        crossing = level.edges.where("block <> far").join(known.withColumnRenamed("node", "parent"), "parent").select("block", "child", F.lit(None).cast(node).alias("parent"), "loop")
        entering = known.join(level.blocks, "node").select("block", F.lit(None).cast(node).alias("child"), F.col("node").alias("parent"), "loop")
        inner = inner.where("parent is not null").unionByName(crossing).unionByName(entering)
    else:
        inner = inner.where("parent is not null")

    def find(rows: pa.Table) -> pa.Table:
        edges, out = defaultdict(list), []
        for child, parent, loop in zip(*[rows[c].to_pylist() for c in ("child", "parent", "loop")]):
            a, b = (("loop", loop), (0, parent)) if child is None else ((0, child), ("loop", loop) if parent is None else (0, parent))
            edges[a].append(b)
        for some in _components(edges):
            loops = [v for k, v in some if k == "loop"]
            nodes = [v for k, v in some if k != "loop"]
            name = min(loops) if loops else min(nodes)
            out += [(n, name) for n in nodes]
        return _table(out, {"node": rows["loop"].type, "loop": rows["loop"].type})

    return inner.groupBy("block").applyInArrow(find, f"node {node}, loop {node}")


def _peeled(edges: DataFrame, limit: int = 100_000) -> DataFrame:
    """Edges between nodes that have edges on both sides, after all others are taken away, again and again."""
    now = staged(edges)
    n = now.count()
    for _ in range(limit):
        on = now.join(now.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").join(now.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        now = staged(on)
        left = now.count()
        if left in (n, 0):
            return now
        n = left
    raise ValueError(f"the peeling wasn't at its end after {limit} rounds")


def cycles(edges: DataFrame, size: int = BLOCK, most: int = 1_000_000, found: list[Level] | None = None) -> DataFrame:
    """(node, loop) of all nodes that are their own ancestors; loop is the least node of those that reach each other.

    Cycles inside a block are found there, those over several blocks in the graph of entries. Where that doesn't get smaller, sources and
    sinks are peeled off in rounds and what is left, cycles and what lies between them, is one task's; more than `most` edges
    of it is an error, as no history that was written by this model has any.
    """
    found = found or levels(edges, size)
    node = edges.schema["child"].dataType.simpleString()
    known: DataFrame | None = None
    for level in reversed(found):
        if level.blocks is None:
            left = _peeled(level.edges.select("child", "parent", "steps"))
            if left.count() > most:
                raise ValueError("the history has cycles throughout")
            level = Level(left.select("child", "parent", "steps", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("far")), None)
        known = staged(_loops_within(level, known, node))
    least = known.groupBy("loop").agg(F.min("node").alias("least"))
    return known.join(least, "loop").select("node", F.col("least").alias("loop")).distinct()
