"""Self-join of documents on the Jaccard similarity of their word n-grams, by chosen paths.

Sets are split recursively: a set follows those of its tokens whose hash under the path so far is small against its
size, so that similar sets keep meeting. All runs start at once: they read disjoint ranges of one hash, which makes
their first tokens the set's lowest `runs` ranges. Small buckets are compared whole, buckets that stay large after the
last level in pairs of blocks. A pair of sets is compared in the first of the buckets that both are in, so links are
counted once without listing pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_array, components, dropped, mix, runs, shingle_hashes, slices, small, staged

LEVELS, SMALL, BLOCK, SKETCH = 3, 48, 512, 64
_M = U64(0xD6E8FEB86659FD93)


def runs_needed(recall: float, similarity: float, levels: int = LEVELS) -> int:
    """Runs after which two sets of the given similarity have met in some bucket with the target probability.

    A pair follows its common tokens below the threshold of its larger set, 1 / (similarity * size), a Poisson number. Its
    mean is (size of the union) / (size of the larger set): 2 / (1 + similarity) for equal sizes, and 1 at the least, if one
    set holds the other, whatever the similarity. So a path of the pair dies at a level with a probability that is a fixed
    point iteration.
    """
    mean = 1.0
    die = 0.0
    for _ in range(levels - 1):
        die = math.exp(-mean * (1 - die))
    return max(1, math.ceil(-math.log(1 - recall) / (mean * (1 - die))))


def _unique_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sorted distinct shingles of each text."""
    off, h = shingle_hashes(texts, k)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    by = np.lexsort((h, doc))
    h, doc = h[by], doc[by]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[first], doc[first]
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(off) - 1))]), h


def _below(h: np.ndarray, share: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(np.float64) < share * 2.0**53


def _paths(off: np.ndarray, h: np.ndarray, similarity: float, repeats: int, levels: int):
    """Per level: (set, path, path above) of all sets, as if every bucket had to be split."""
    size = np.diff(off)
    share = 1.0 / (similarity * np.maximum(size, 1))
    doc = np.repeat(np.arange(len(size)), size)
    chosen = np.flatnonzero(_below(mix(h ^ U64(0x5DEECE66D)), (share * repeats)[doc]))
    at, path = doc[chosen], mix(h[chosen] * _M)
    out = [(at, path, np.zeros(len(path), dtype=U64))]
    for _ in range(levels - 1):
        n = size[at]
        ends = np.cumsum(n)
        up = np.repeat(np.arange(len(at)), n)
        token = h[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(off[:-1][at], n)]
        step = mix(token * _M + path[up])
        keep = np.flatnonzero(_below(step, share[at][up]))
        up, new = up[keep], mix(step[keep])
        out.append((at[up], new, path[up]))
        at, path = at[up], new
    return out


def _sketch(off: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One-permutation min-hashes of SKETCH bins, a byte each (0: an empty bin)."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    g = mix(h ^ U64(0x2545F4914F6CDD1D))
    slot = doc * SKETCH + (g % U64(SKETCH)).astype(np.int64)
    by = np.lexsort((g, slot))
    first = np.ones(len(by), dtype=bool)
    first[1:] = slot[by][1:] != slot[by][:-1]
    out = np.zeros((len(off) - 1) * SKETCH, dtype=np.uint8)
    out[slot[by][first]] = ((g[by][first] >> U64(40)) % U64(255)).astype(np.uint8) + 1
    return out.reshape(-1, SKETCH)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U64).view(np.int64))


def _base(docs: DataFrame, k: int, similarity: float, repeats: int) -> DataFrame:
    """One row a document: id, key of its text, key and size of its shingle set, sketch, and its paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1_500_000):
                off, h = _unique_sets(as_array(b.column("text")), k)
                size = np.diff(off)
                csum = lambda x: np.diff(np.concatenate([np.zeros(1, dtype=U64), np.cumsum(x, dtype=U64)])[off])
                a, z = csum(mix(h)), csum(mix(h * _M + U64(7)))
                key = np.stack([mix(a + size.astype(U64)), mix(z)], axis=1)
                levels = _paths(off, h, similarity, repeats, LEVELS)
                cols = []
                for at, path, up in levels:
                    by = np.argsort(at, kind="stable")
                    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(size)))]).astype(np.int32))
                    cols += [pa.ListArray.from_arrays(ends, _signed(path[by])), pa.ListArray.from_arrays(ends, _signed(up[by]))]
                keys = pa.array([x.tobytes() for x in key], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("did"), b.column("tkey"), keys, pa.array(size), pa.array([x.tobytes() for x in _sketch(off, h)], pa.binary()), *cols], names=["did", "tkey", "skey", "n", "sketch", *(f"{x}{i}" for i in range(LEVELS) for x in "pu")])

    arrays = ", ".join(f"{x}{i} array<long>" for i in range(LEVELS) for x in "pu")
    return docs.mapInArrow(run, f"did long, tkey string, skey binary, n long, sketch binary, {arrays}")


def _dealt(leaves: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of leaves as rows of buckets; a bucket of over BLOCK rows becomes one for each pair of its blocks."""
    rows = leaves.join(sizes, "leaf")
    blocks = F.ceil(F.col("m") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("skey"), blocks)
    other = F.when(blocks > 1, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.lit(0).cast("long")))
    rows = rows.withColumn("blk", own).withColumn("other", F.explode(other))
    pair = F.struct(F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"))
    return rows.withColumn("cross", F.col("blk") != F.col("other")).withColumn("bucket", F.xxhash64("leaf", pair["x"], pair["y"])).drop("m", "other")


def _pairs(t: pa.Table, similarity: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By bucket, in its rows: where it starts, and the pairs that may be similar and have this bucket as their first common one."""
    keys = t["bucket"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n, leaf = t["n"].to_numpy(), t["leaf"].to_numpy()
    sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
    lists = t["leaves"].combine_chunks()
    loff, lval = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
    blk, cross = t["blk"].to_numpy(), t["cross"].to_numpy(zero_copy_only=False)
    least = (similarity - 0.27) * (1 - 1 / 255)
    for s, e in zip(starts, [*starts[1:], len(keys)]):
        m = e - s
        if m < 2:
            continue
        found_a, found_b = [], []
        for i in range(m - 1):
            rest = np.arange(i + 1, m)
            ni, nr = n[s + i], n[s + 1 + i : e]
            ok = np.minimum(ni, nr) >= similarity * np.maximum(ni, nr)
            if cross[s + i]:
                ok &= blk[s + 1 + i : e] != blk[s + i]
            rest = rest[ok]
            if len(rest):
                rest = rest[(sketch[s + rest] == sketch[s + i]).mean(axis=1) >= least]
            if len(rest):
                found_a.append(np.full(len(rest), i))
                found_b.append(rest)
        if not found_a:
            continue
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        # the first common leaf of both, in order of value, must be this one
        here = leaf[s]
        mine = [set((x := lval[loff[s + i] : loff[s + i + 1]])[x < here].tolist()) for i in range(m)]
        keep = np.array([mine[i].isdisjoint(mine[j]) for i, j in zip(a.tolist(), b.tolist())], dtype=bool)
        if keep.any():
            yield s, a[keep], b[keep]


def _similar(off: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs of sets have at least the similarity, exactly."""
    size = np.diff(off)
    if len(a) <= 4 * len(size):
        both = np.array([len(np.intersect1d(h[off[i] : off[i + 1]], h[off[j] : off[j + 1]], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())])
    else:
        token = np.unique(h, return_inverse=True)[1]
        doc = np.repeat(np.arange(len(size)), size)
        by = np.argsort(token, kind="stable")
        token, doc = token[by], doc[by]
        shared = np.zeros((len(size), len(size)), dtype=np.float32)
        width = 4096
        edges = np.searchsorted(token, np.arange(0, (token[-1] if len(token) else 0) + width + 1, width))
        for c, (x, y) in enumerate(zip(edges[:-1], edges[1:])):
            block = np.zeros((len(size), width), dtype=np.float32)
            block[doc[x:y], token[x:y] - c * width] = 1
            shared += block @ block.T
        both = shared[a, b]
    return both >= similarity * (size[a] + size[b] - both) - 1e-9


def similar_documents(docs: DataFrame, similarity: float = 0.8, k: int = 5, recall: float = 0.99, id_col: str = "doc_id", text_col: str = "text", held: list[DataFrame] | None = None) -> DataFrame:
    """(doc_id, class_id, n_links): the number of other documents that are at least so similar, and the least id of all that such links connect.

    Sets of k-word shingles of the lower-case text; a text of fewer words is one shingle. Found links are verified on
    whole texts; each is found with at least the given probability (equal sets always). Documents of equal sets are
    compared once and counted in full. A text without words (also null) links to nothing and is its own class. A null
    id counts as the least and is returned as null. Repeated rows are documents of their own, with equal results. held: a list
    that the written tables which the result is read from are put on, for those who write the result and drop these.
    """
    least = -(2**63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("did"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tkey", F.md5("text"))
    base = staged(_base(rows, k, similarity, runs_needed(recall, similarity)))
    firsts = [F.first(c).alias(c) for c in ("n", "sketch", *(f"{x}{i}" for i in range(LEVELS) for x in "pu"))]
    classes = staged(base.where("n > 0").groupBy("skey").agg(F.count("*").alias("copies"), F.min(F.struct("did", "tkey")).alias("rep"), *firsts))
    own = staged(base.select("did", F.when(F.col("n") > 0, F.col("skey")).alias("skey")))  # all that is read of it again
    dropped(base)
    # split level by level; a bucket of one set is dropped, of up to SMALL kept, and a larger one split further
    level = classes.select("skey", F.explode("p0").alias("leaf"))
    done, levels = [], []
    for i in range(LEVELS):
        sizes = staged(level.groupBy("leaf").agg(F.count("*").alias("m")).where("m > 1"))
        levels.append(sizes)
        last = i == LEVELS - 1
        done.append((level, sizes if last else sizes.where(F.col("m") <= SMALL)))
        if not last:
            large = sizes.where(F.col("m") > SMALL).select(F.col("leaf").alias("up"))
            below = classes.select("skey", F.explode(F.arrays_zip(F.col(f"p{i + 1}").alias("leaf"), F.col(f"u{i + 1}").alias("up"))).alias("x")).select("skey", "x.leaf", "x.up")
            level = staged(below.join(large, "up", "left_semi").drop("up"))
            levels.append(level)
    leaves = done[0][0].join(done[0][1], "leaf")
    for rows_of, sizes in done[1:]:
        leaves = leaves.union(rows_of.join(sizes, "leaf"))
    leaves = staged(leaves)
    for x in levels:
        dropped(x)
    lists = leaves.groupBy("skey").agg(F.collect_list("leaf").alias("leaves"))  # a set has a few dozen leaves at most
    facts = classes.select("skey", "n", "sketch", "copies", "rep").join(lists, "skey")
    sizes = leaves.select("leaf", "m").distinct()
    dealt = _dealt(leaves.select("skey", "leaf"), sizes).join(facts, "skey")
    kept = ["bucket", "leaf", "blk", "cross", "skey", "n", "sketch", "leaves"]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "bucket"):
            hit = np.zeros(len(t), dtype=bool)
            for s, a, b in _pairs(t, similarity):
                hit[s + a] = hit[s + b] = True
            yield from t.filter(pa.array(hit)).combine_chunks().to_batches()

    schema = "bucket long, leaf long, blk long, cross boolean, skey binary, n long, sketch binary, leaves array<long>, copies long, did long, tkey string"
    flat = dealt.select(*kept, "copies", F.col("rep.did").alias("did"), F.col("rep.tkey").alias("tkey"))
    hit = staged(flat.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(candidates, schema))
    dropped(leaves)
    needed = hit.select("did", "tkey").distinct()
    texts = rows.join(needed, ["did", "tkey"]).dropDuplicates(["did", "tkey"])
    ready = hit.join(texts, ["did", "tkey"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "bucket", 2_000):
            off, h = _unique_sets(as_array(t["text"]), k)
            copies, skey, out = t["copies"].to_numpy(), t["skey"].to_pylist(), []
            keys = t["bucket"].to_numpy()
            edges = [*np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist(), len(keys)]
            ends = dict(zip(edges[:-1], edges[1:]))
            for s, a, b in _pairs(t, similarity):
                e = ends[int(s)]
                o = off[s : e + 1]
                ok = _similar(o - o[0], h[o[0] : o[-1]], a, b, similarity)
                a, b = a[ok], b[ok]
                links = np.bincount(a, weights=copies[s + b], minlength=e - s) + np.bincount(b, weights=copies[s + a], minlength=e - s)
                root = np.arange(e - s)
                while True:  # the least row of each part of the bucket that links connect
                    new = root.copy()
                    np.minimum.at(new, a, root[b])
                    np.minimum.at(new, b, root[a])
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                out += [(skey[s + i], int(links[i]), skey[s + root[i]]) for i in np.flatnonzero(links)]
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(v, x) for v, x in zip(cols, (pa.binary(), pa.int64(), pa.binary()))], names=["skey", "links", "root"])

    linked = staged(ready.select(*kept, "copies", "text").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(verified, "skey binary, links long, root binary"))
    dropped(hit)
    if held is not None:
        held += [own, classes, linked]
    links = linked.groupBy("skey").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("skey").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "skey")
    found = classes.select("skey", "copies", F.col("rep.did").alias("first")).join(links, "skey", "left").join(roots, "skey", "left").withColumn("root", F.coalesce("root", "skey"))
    ids = found.groupBy("root").agg(F.min("first").alias("class"))
    per_set = found.join(ids, "root").select("skey", "class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = own.join(per_set, "skey", "left")
    null = lambda c: F.when(c != least, c)
    return out.select(null(F.col("did")).alias("doc_id"), null(F.coalesce("class", "did")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", **how) -> DataFrame:
    """docs with one document of each class of similar_documents(), that of the least id; of repeated rows (one id, one text) one stays."""
    held: list[DataFrame] = []
    found = staged(similar_documents(docs, similarity, id_col=id_col, held=held, **how))
    for x in held:
        dropped(x)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(F.broadcast(gone) if small(gone, 100_000) else gone, F.col(id_col).eqNullSafe(F.col("_gone")), "left_anti")
    twice = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_twice"))
    if not twice.limit(1).count():
        return kept
    hint = F.broadcast(twice) if small(twice) else twice
    same = F.col(id_col).eqNullSafe(F.col("_twice"))
    return kept.join(hint, same, "left_anti").union(kept.join(hint, same, "left_semi").dropDuplicates([id_col, how.get("text_col", "text")]))
