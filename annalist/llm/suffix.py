"""Removal of long repeated byte strings by blockwise suffix sorting with a cover sample.

Only suffixes that can share `length` bytes with another are sorted. Every string of `length` bytes has an anchor, the
k-gram of least hash in it, so equal strings have equal anchors at equal distances. Suffixes fall into buckets by their
anchor's hash (the blocks, which Spark deals to tasks); those whose anchor occurs once in the corpus have no partner. An
anchor's suffixes reach over one passage around it, its context; contexts that occur twice as a whole repeat as a whole,
and only the others are sorted. In a bucket, positions that lie a multiple of PERIOD from the anchor form the cover
sample. It is ranked by doubling; suffixes tied on their first bytes are then told apart by the rank at the next sample
position and the bytes that end the string. Suffixes that may be equal have the same distance to their anchor, so the
cover needs one residue, not the differences of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, dropped, mix, powers, runs, sliding_min, staged

GRAM, PERIOD = 64, 16
#: A bucket of more contexts than this is split by what its suffixes have in common, SLICE distances at a time.
HOT, SLICE = 1000, 16
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = 30


def _bytes(col) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in col.cast(pa.binary())]


def _prefix(b: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, dtype=U64), np.cumsum((b.astype(U64) + U64(1)) * powers(_BASE, len(b)), dtype=U64)])


def anchors(b: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of a text: anchors' hashes, positions, first and last start of the strings that each is the anchor of, and a hash of its context."""
    none = np.zeros(0, dtype=np.int64)
    if len(b) < length:
        return none.astype(U64), none, none, none, none.astype(U64)
    prefix, back = _prefix(b), powers(_INVERSE, len(b))
    n = len(b) - GRAM + 1
    h = mix((prefix[GRAM:] - prefix[:-GRAM]) * back[:n])
    place = np.arange(n, dtype=np.int64)
    best = sliding_min(((h >> U64(_PLACE)) << U64(_PLACE) >> U64(1)).astype(np.int64) | place, length - GRAM + 1) & ((1 << (_PLACE - 1)) - 1)
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    last = np.concatenate([first[1:], [len(best)]]) - 1
    at = best[first]
    context = mix((prefix[last + length] - prefix[first]) * back[first] + (at - first).astype(U64) * U64(0xA24BAED4963EE407) + (last - first).astype(U64))
    return h[at], at, first, last, context


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U64).view(np.int64))


def _equal_rank(*cols: np.ndarray) -> np.ndarray:
    """Dense numbers of equal rows, in order of the columns."""
    if not len(cols[0]):
        return np.zeros(0, dtype=np.int64)
    by = np.lexsort(cols[::-1])
    new = np.zeros(len(by), dtype=bool)
    for c in cols:
        s = c[by]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(by), dtype=np.int64)
    out[by] = np.cumsum(new)
    return out


def _words(block: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16 bytes from each position as two numbers."""
    x = np.lib.stride_tricks.sliding_window_view(block, 16)[at]
    x = np.ascontiguousarray(x).view(">u8")
    return x[:, 0].astype(U64), x[:, 1].astype(U64)


def repeated_starts(bucket: np.ndarray, contexts: list[bytes], anchor: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Sort the suffixes of whole buckets: whether each start of each context (context after context, starts[i] of them)
    begins a string of `length` bytes that also begins elsewhere in its bucket. anchor: its offset in each context."""
    block = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    size = np.array([len(c) for c in contexts], dtype=np.int64)
    base = np.cumsum(size) - size
    # the cover sample: positions with PERIOD bytes left that are a multiple of PERIOD from the anchor
    lead = anchor % PERIOD
    count = np.maximum((size - lead) // PERIOD, 0)
    cover = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - cover[owner]
    hi, lo = _words(block, base[owner] + lead[owner] + nth * PERIOD)
    rank, step, ranks = _equal_rank(hi, lo), 1, {1: None}
    room = count[owner] - nth  # sample positions from here to the context's end

    def ahead(r: np.ndarray, k: int) -> np.ndarray:
        """The rank k sample positions on, -1 past the context's end."""
        out = np.full(len(r), -1, dtype=np.int64)
        ok = np.flatnonzero(room > k)
        out[ok] = r[ok + k]
        return out

    ranks = {1: rank}
    need = (length - PERIOD) // PERIOD
    while step * 2 <= need:
        ranks[2 * step] = _equal_rank(ranks[step], ahead(ranks[step], step))
        step *= 2
    whole, got = ranks[step], step
    for k in sorted(ranks, reverse=True):
        while got + k <= need:
            whole, got = _equal_rank(whole, ahead(ranks[k], got)), got + k
    # suffixes: those of one distance to the anchor whose next sample position has equal rank are tied so far
    of = np.repeat(np.arange(len(size)), starts)
    s = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts)
    t = anchor[of] - s
    sample = cover[of] + (s + t % PERIOD - lead[of]) // PERIOD
    tie = whole[sample] * (1 << 10) + t
    order = np.argsort(tie, kind="stable")
    same = np.concatenate([[False], tie[order][1:] == tie[order][:-1]])
    tied = order[same | np.concatenate([same[1:], [False]])]
    out = np.zeros(len(of), dtype=bool)
    if len(tied):
        at = base[of[tied]] + s[tied]
        cols = (bucket[of[tied]], tie[tied], *_words(block, at), *_words(block, at + length - 16))
        rank = _equal_rank(*cols)
        out[tied] = np.bincount(rank)[rank] > 1
    return out


def repeated_ranges(docs: DataFrame, length: int = 400, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(tkey, start, end): byte ranges, which may overlap, that repeated strings of `length` bytes cover, by md5 of the text."""
    if length % PERIOD or length < 2 * GRAM or length > 1024 - PERIOD:
        raise ValueError("length must be a multiple of 16 from 128 to 1008")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("did"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") >= length).withColumn("tkey", F.unhex(F.md5("text")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, size = batch.column("text"), [], 0
            index: list[int] = []

            def flush():
                cols = [np.concatenate(x) for x in zip(*found)]
                take = pa.array(np.repeat(index, [len(x[0]) for x in found]))
                out = [_signed(cols[0]), _signed(cols[4]), batch.column("did").take(take), batch.column("tkey").take(take), *(pa.array(x) for x in (cols[1], cols[2], cols[3]))]
                return pa.RecordBatch.from_arrays(out, names=["h", "c", "did", "tkey", "at", "lo", "hi"])

            for i in range(batch.num_rows):
                x = anchors(np.frombuffer(texts[i].as_buffer(), dtype=np.uint8), length)
                found.append(x)
                index.append(i)
                size += len(x[0])
                if size > 50_000:
                    yield flush()
                    found, index, size = [], [], 0
            if found:
                yield flush()

    kind = "h long, c long, did long, tkey binary, at long, lo long, hi long"
    every = staged(rows.select("did", "tkey", "text").mapInArrow(find, kind))
    often = staged(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").drop("n"))  # written, so that the join can split a hot anchor
    marks = staged(every.join(often, "h"))
    dropped(every)
    dropped(often)
    contexts = staged(marks.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("did", "tkey", "at", "lo", "hi")).alias("rep")))
    twice = contexts.where("n > 1").select("h", "c")
    decided = marks.join(twice, ["h", "c"], "left_semi").select("tkey", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    mixed = contexts.groupBy("h").agg(F.count("*").alias("k"), F.count_if(F.col("n") == 1).alias("once")).where("k > 1 and once > 0")
    open_ = contexts.join(mixed, "h").select("h", "n", "rep.*", (F.col("k") > HOT).alias("hot"))
    texts = rows.join(open_.select("did", "tkey").distinct(), ["did", "tkey"]).dropDuplicates(["did", "tkey"]).join(open_, ["did", "tkey"])
    cut = texts.select("h", "n", "tkey", "hot", "at", "lo", "hi", F.expr(f"substring(encode(text, 'UTF-8'), int(lo + 1), int(hi - lo + {length}))").alias("bytes"))
    suffixes = "bucket long, n long, tkey binary, frm long, far long, starts long, bytes binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a bucket: its context. A hot bucket's context becomes one row for each SLICE of distances to the
        anchor, in a bucket that is named by the bytes which all strings of these distances hold."""
        for b in batches:
            hot = b.column("hot").to_pylist()
            h, at, lo, hi = (b.column(c).to_pylist() for c in ("h", "at", "lo", "hi"))
            bucket, take, frm, fars, starts, raw = [], [], [], [], [], []
            for i, data in enumerate(_bytes(b.column("bytes"))):
                far, near = at[i] - lo[i], at[i] - hi[i]  # distances of its first and last string
                for x in range(near // SLICE * SLICE, far + 1, SLICE) if hot[i] else [None]:
                    a, z, key = near, far, h[i]
                    if x is not None:
                        a, z = max(near, x), min(far, x + SLICE - 1)
                        name = b"%d %d " % (h[i], x) + data[far - x : far - x - SLICE + 1 + length]
                        key = int.from_bytes(hashlib.md5(name).digest()[:8], "little", signed=True)
                    bucket.append(key)
                    take.append(i)
                    frm.append(lo[i] + far - z)
                    fars.append(z)
                    starts.append(z - a + 1)
                    raw.append(data[far - z : far - a + length])
            at_row = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), b.column("n").take(at_row), b.column("tkey").take(at_row), *(pa.array(v, pa.int64()) for v in (frm, fars, starts)), pa.array(raw, pa.binary())], names=["bucket", "n", "tkey", "frm", "far", "starts", "bytes"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "bucket", 2000):
            bucket, starts, frm, once = (t[c].to_numpy() for c in ("bucket", "starts", "frm", "n"))
            hit = repeated_starts(bucket, _bytes(t["bytes"].combine_chunks()), t["far"].to_numpy(), starts, length)
            of = np.repeat(np.arange(len(starts)), starts)
            hit &= once[of] == 1  # contexts that occur more often are decided
            place = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts) + frm[of]
            i = np.flatnonzero(hit)
            if len(i):
                first = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (of[i][1:] != of[i][:-1])]))
                last = np.concatenate([first[1:], [len(i)]]) - 1
                yield pa.RecordBatch.from_arrays([t["tkey"].combine_chunks().take(pa.array(of[i[first]])), pa.array(place[i[first]]), pa.array(place[i[last]] + length)], names=["tkey", "start", "end"])

    plain = cut.where("not hot").mapInArrow(deal, suffixes)
    # equal slices of hot contexts repeat as a whole: they are summed before the shuffle, and one of them is sorted among the others
    sliced = staged(cut.where("hot").mapInArrow(deal, suffixes))
    same = ["bucket", "far", "starts", "bytes"]
    summed = staged(sliced.groupBy(*same).agg(F.sum("n").alias("n"), F.min(F.struct("tkey", "frm")).alias("rep")))
    alike = summed.where("n > 1").select(*same)
    repeated = sliced.where("n = 1").join(alike, same, "left_semi").select("tkey", F.col("frm").alias("start"), (F.col("frm") + F.col("starts") - 1 + length).alias("end"))
    one = summed.select("bucket", "n", "rep.tkey", "rep.frm", "far", "starts", "bytes")
    dealt = plain.union(one).repartition("bucket").sortWithinPartitions("bucket")
    return decided.union(repeated).union(dealt.mapInArrow(sort, "tkey binary, start long, end long"))


def remove_repeats(docs: DataFrame, length: int = 400, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with sa_spans, the maximal byte ranges [start, end) of its UTF-8 text that strings of `length` bytes cover
    which also begin elsewhere in the corpus, and sa_kept, the other bytes (binary).

    Judged on the input: overlaps count, the same text included; no string crosses documents. A repeated row or an equal
    text of at least `length` bytes repeats as a whole, so all of it goes. Null, empty and shorter texts keep all (no
    spans). Equal context hashes (64 bits beside a 64-bit anchor) are taken for equal contexts; all else is compared
    exactly. Other columns stay and may have any names but sa_*.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ranges in b.column("x").to_pylist():
                spans: list[dict] = []
                for r in sorted(ranges, key=lambda r: r["start"]):
                    if spans and r["start"] <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], r["end"])
                    else:
                        spans.append({"start": r["start"], "end": r["end"]})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([b.column("sa_tkey"), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["sa_tkey", "sa_spans"])

    ranges = repeated_ranges(docs, length, text_col, id_col).distinct().groupBy(F.col("tkey").alias("sa_tkey")).agg(F.collect_list(F.struct("start", "end")).alias("x"))  # of one text
    spans = staged(ranges.mapInArrow(merge, "sa_tkey binary, sa_spans array<struct<start:bigint,end:bigint>>"))
    keyed = docs.withColumn("sa_tkey", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    out = keyed.join(spans, "sa_tkey", "left").drop("sa_tkey")
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    ends = F.concat(F.lit([0]).cast("array<bigint>"), F.transform("sa_spans", lambda x: x["end"]))
    starts = F.concat(F.transform("sa_spans", lambda x: x["start"]), F.array(F.octet_length(raw).cast("long")))
    gaps = F.arrays_zip(ends.alias("a"), starts.alias("z"))
    kept = F.aggregate(gaps, F.lit(b""), lambda acc, g: F.concat(acc, F.substring(raw, (g["a"] + 1).cast("int"), (g["z"] - g["a"]).cast("int"))))
    spans_or_none = F.coalesce("sa_spans", F.lit([]).cast("array<struct<start:bigint,end:bigint>>"))
    return out.withColumn("sa_kept", F.when(F.col("sa_spans").isNull(), raw).otherwise(kept)).withColumn("sa_spans", spans_or_none)


def without_repeats(docs: DataFrame, length: int = 400, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with their repeats cut out of the text, and its n_chars set anew if they have such a column. A character that a cut divides goes whole; a text that repeats as a whole becomes empty."""
    found = remove_repeats(docs, length, text_col, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            texts = b.column(text_col).to_pylist()
            for i, spans in enumerate(b.column("sa_spans").to_pylist()):
                if spans:
                    raw, at, out = texts[i].encode(), 0, []
                    for s in [*spans, {"start": len(raw), "end": None}]:
                        out.append(raw[at : s["start"]].decode("utf-8", "ignore"))
                        at = s["end"]
                    texts[i] = "".join(out)
            cols = {c: b.column(c) for c in names if c != "sa_spans"} | {text_col: pa.array(texts, pa.string())}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return found.select(*docs.columns, "sa_spans").mapInArrow(run, docs.schema)
