"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all trees, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Rows at most of the sample that the trees' planes are drawn from, and bytes at most that it may take.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64_000_000


class Forest:
    """Trees as arrays: of node i, planes[i] and offset[i] send x to child[i, 1] if x . plane > offset, else to child[i, 0]; a negative child -1 - l is leaf l."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        planes, offset, child, roots, leaves = [], [], [], [], 0
        for _ in range(trees):
            todo, root = [(np.arange(len(sample)), None)], None
            while todo:
                rows, above = todo.pop()
                side = None
                if len(rows) > leaf:
                    for _ in range(4):
                        a, b = sample[rng.choice(rows, 2, replace=False)].astype(np.float64)
                        if not (norm := np.linalg.norm(a - b)):
                            continue
                        plane = ((a - b) / norm).astype(np.float32)
                        at = sample[rows] @ plane
                        middle = np.median(at)
                        side = at > middle
                        if 0.05 < side.mean() < 0.95:
                            break
                        side = None
                if side is None:
                    me, leaves = -1 - leaves, leaves + 1
                else:
                    me = len(planes)
                    planes.append(plane)
                    offset.append(middle)
                    child.append([0, 0])
                    todo += [(rows[~side], (me, 0)), (rows[side], (me, 1))]
                if above is None:
                    root = me
                else:
                    child[above[0]][above[1]] = me
            roots.append(root)
        dim = sample.shape[1] if sample.ndim == 2 else 0
        self.planes, self.offset = np.array(planes, dtype=np.float32).reshape(-1, dim), np.array(offset, dtype=np.float32)
        self.child, self.roots, self.leaves = np.array(child, dtype=np.int64).reshape(-1, 2), roots, leaves

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.empty((len(x), len(self.roots)), dtype=np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                right = np.einsum("ij,ij->i", x[inner], self.planes[node]) > self.offset[node]
                at[inner] = self.child[node, right.astype(np.int64)]
            out[:, t] = -1 - at
        return out

    def search(self, q: np.ndarray, size: np.ndarray, want: int) -> list[int]:
        """Leaves in order of the least margin on the way to them, over all trees at once, until they hold want rows."""
        heap = [(0.0, r) for r in self.roots]
        margins = self.planes @ q - self.offset
        out, got = [], 0
        while heap and got < want:
            cost, node = heapq.heappop(heap)
            while node >= 0:
                m = float(margins[node])
                heapq.heappush(heap, (max(cost, abs(m)), int(self.child[node, 0 if m > 0 else 1])))
                node = int(self.child[node, 1 if m > 0 else 0])
            if size[-1 - node]:
                out.append(-1 - node)
                got += int(size[-1 - node])
        return out


def matrix(col) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part: id and vector given, each component finite, not all zero. Rows of one id count as one (the least vector)."""
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    v = F.col(vec_col).cast("array<float>" if kind == "float" else "array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, trees: int = 20, leaf: int = 32, search: int = 40_000, share: float = 0.75, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows (Euclidean) found for each row whose id is divisible by every: (query_id, rank, vec_id, score).

    The planes are fitted on at most SAMPLE_ROWS rows, chosen by a hash of the id; every row is indexed. Of equal
    vectors only the k + 1 least ids can be among a query's k nearest, so only these are indexed, which also keeps a
    vector shared by many rows from filling a leaf. Leaves of more than 4,096 rows are dealt to several tasks.
    A query looks into leaves until they hold `search` rows, or `share` of all if that is more (a row counts once a tree):
    vectors without any structure need that for a recall of 0.9; for clustered ones a tenth will do. Ties go
    to the smaller id; fewer than k rows give what there is; an empty table gives an empty result. Vectors must be of
    one length (the most frequent; others take no part).
    """
    rows = usable(vectors, id_col, vec_col)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], schema)
    dim, n = dims[0]["d"], dims[0]["count"]
    rows = staged(rows.where(F.size("v") == dim))
    search, vector = max(search, int(share * n)), rows.schema["v"].dataType.simpleString()
    distinct = staged(rows.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= k + 1).drop("_r"))
    bound = max(2, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    chosen = distinct.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= F.lit(int(1.1 * bound / n * (1 << 20)))).orderBy(F.xxhash64("id")).limit(bound).select("v").toArrow()
    forest = Forest(matrix(chosen["v"].combine_chunks()).astype(np.float32).reshape(-1, dim), trees, leaf, seed)
    shared = spark.sparkContext.broadcast(forest)  # planes of a bounded sample

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = shared.value.leaf_of(matrix(b.column("v")).astype(np.float32))
            for t in range(of.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(of[:, t]), b.column("id"), b.column("v")], names=["leaf", "id", "v"])

    indexed = distinct.mapInArrow(index, f"leaf long, id long, v {vector}")
    size = np.zeros(forest.leaves, dtype=np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # one row a leaf, of which the sample bounds the number
        size[r["leaf"]] = r["count"]
    pieces = np.maximum(1, -(-size // 4096))
    held = spark.sparkContext.broadcast((size, pieces))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, pieces = held.value
        for b in batches:
            ids, x = b.column("id").to_numpy(), matrix(b.column("v"))
            for i in range(len(ids)):
                found = np.array(shared.value.search(x[i].astype(np.float32), size, search), dtype=np.int64)
                times = pieces[found]
                leaf = np.repeat(found, times)
                piece = np.arange(len(leaf)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(piece), pa.array(np.full(len(leaf), ids[i])), pa.array([x[i].tolist()] * len(leaf), b.column("v").type)], names=["leaf", "piece", "query", "q"])

    def near(queries: pa.Table, members: pa.Table) -> pa.Table:
        out = [], [], []
        if len(queries) and len(members):
            ids, x = members["id"].to_numpy(), matrix(members["v"].combine_chunks()).astype(np.float64)
            for query, q in zip(queries["query"].to_pylist(), matrix(queries["q"].combine_chunks()).astype(np.float64)):
                d = np.sqrt(np.square(x - q).sum(axis=1))
                d = np.where(ids == query, np.inf, d)
                cut = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
                best = np.flatnonzero((d <= cut) & (d < np.inf))
                best = best[np.lexsort((ids[best], d[best]))][:k]
                out[0].append(np.full(len(best), query))
                out[1].append(ids[best])
                out[2].append(d[best])
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, dtype=t)
        return pa.table({"query_id": cat(out[0], np.int64), "vec_id": cat(out[1], np.int64), "score": cat(out[2], np.float64)})

    asked = rows.where(F.col("id") % every == 0).mapInArrow(leaves, f"leaf long, piece long, query long, q {vector}")
    counts = spark.createDataFrame(pa.table({"leaf": np.arange(forest.leaves), "pieces": pieces}).to_pandas(), "leaf long, pieces long") if (pieces > 1).any() else None
    members = indexed.withColumn("pieces", F.lit(1)) if counts is None else indexed.join(F.broadcast(counts), "leaf")
    members = members.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces"))).drop("pieces")
    found = asked.groupBy("leaf", "piece").cogroup(members.groupBy("leaf", "piece")).applyInArrow(near, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
