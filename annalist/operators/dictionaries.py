"""Training of compression dictionaries: which bytes many payloads of a realm share, and what a dictionary of them saves."""

from __future__ import annotations

import heapq
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Payloads that training needs, bytes of a dictionary at most, the share of the samples that it is built from, the level it is scored at.
MIN_SAMPLES, MAX_BYTES, BUILD_SHARE, SCORE_LEVEL = 32, 112_640, 0.5, 19
#: Payloads of a realm that are looked at, bytes of each, and bytes of a gram and of a piece of the dictionary.
SAMPLES, LONGEST, GRAM, PIECE = 400, 65_536, 8, 256


def sampled(payloads: DataFrame, by: str, payload: str, samples: int = SAMPLES) -> DataFrame:
    """(realm, place, part, body): so many payloads of each realm, those of least digest, so that every run takes the same and none is near another.

    Equal payloads count once, null and empty ones not at all. The first half is to build from, the rest to score by; bodies are cut at 64 KB.
    The limit by rank is applied before the shuffle, so a realm that has most rows brings no more of them than others.
    """
    body = F.encode(F.col(payload).cast("string"), "utf-8")
    rows = payloads.where(F.length(payload) > 0).select(F.col(by).alias("realm"), body.alias("body")).withColumn("digest", F.sha2("body", 256))
    ranked = rows.withColumn("_r", F.dense_rank().over(Window.partitionBy("realm").orderBy("digest"))).where(F.col("_r") <= samples)
    once = ranked.groupBy("realm", F.col("_r").alias("place")).agg(F.first("body").alias("body"))
    n = F.count("*").over(Window.partitionBy("realm"))
    part = F.when(F.col("place") <= F.greatest(F.lit(1), F.floor(n * BUILD_SHARE)), "build").otherwise("score")
    return once.select("realm", "place", part.alias("part"), F.substring("body", 1, LONGEST).alias("body"))


def gram_counts(build: DataFrame, gram: int = GRAM) -> DataFrame:
    """(realm, gram, n): in how many samples each run of bytes occurs, of those that occur in two or more."""
    starts = F.sequence(F.lit(1), F.length("body") - gram + 1)
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("body"), i, F.lit(gram))))
    rows = build.where(F.length("body") >= gram).select("realm", F.explode(grams).alias("gram"))
    return rows.groupBy("realm", "gram").agg(F.count("*").alias("n")).where("n > 1")


def cover(bodies: list[bytes], counts: dict[bytes, int], most: int = MAX_BYTES, gram: int = GRAM, piece: int = PIECE) -> bytes:
    """A dictionary from samples: piece by piece, the one whose grams, not covered yet, occur in the most samples; the best stand last.

    Worths only fall as grams are covered, so a piece taken from the heap is reckoned anew and put back if another may be worth more now.
    """
    pieces = [b[i : i + piece] for b in bodies for i in range(0, len(b), piece)]
    grams = [{p[i : i + gram] for i in range(len(p) - gram + 1)} & counts.keys() for p in pieces]
    worth = lambda k: sum(counts[g] for g in grams[k] if g not in covered)
    covered: set[bytes] = set()
    heap = [(-sum(counts[g] for g in grams[k]), k) for k in range(len(pieces))]
    heapq.heapify(heap)
    chosen, size = [], 0
    while heap and size < most:
        was, k = heapq.heappop(heap)
        now = worth(k)
        if not now:
            continue
        if heap and now < -heap[0][0]:
            heapq.heappush(heap, (-now, k))
            continue
        chosen.append(pieces[k])
        size += len(pieces[k])
        covered |= grams[k]
    return b"".join(reversed(chosen))[-most:]


def ratio(bodies: list[bytes], dictionary: bytes | None, level: int = SCORE_LEVEL) -> float:
    """Bytes of samples over bytes of their compressed forms, each compressed alone; 1 for nothing."""
    shared = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    if shared:
        shared.precompute_compress(level=level)
    packer = zstandard.ZstdCompressor(level=level, dict_data=shared) if shared else zstandard.ZstdCompressor(level=level)
    raw, small = sum(map(len, bodies)), sum(len(packer.compress(b)) for b in bodies)
    return raw / small if raw and small else 1.0


def training(payloads: DataFrame, by: str, payload: str, samples: int = SAMPLES, most: int = MAX_BYTES) -> DataFrame:
    """By realm: samples, dictionary_bytes, source, baseline, ratio, kept, and the dictionary (null if none helps).

    Two candidates are measured on samples they weren't made from: whole samples one after the other ("raw") and pieces by the
    coverage of their grams ("cover"); the better is kept if it beats no dictionary at all. Realms of fewer than 32 samples have
    no dictionary, and baseline and ratio are null. A task holds one realm's samples: at most 400 of 64 KB, and the grams that they share.
    """
    rows = sampled(payloads, by, payload, samples)
    grams = gram_counts(rows.where("part = 'build'"))
    kind = rows.schema["realm"].dataType.simpleString()
    out = f"realm {kind}, samples long, source string, dictionary_bytes long, baseline double, ratio double, kept boolean, dictionary binary"

    def train(key: tuple, samples_: pa.Table, counted: pa.Table) -> pa.Table:
        found = sorted(samples_.to_pylist(), key=lambda r: r["place"])
        counts = {r["gram"]: r["n"] for r in counted.to_pylist()}
        row = {"realm": key[0].as_py(), "samples": len(found), "source": None, "dictionary_bytes": 0, "baseline": None, "ratio": None, "kept": False, "dictionary": None}
        build, score = ([r["body"] for r in found if r["part"] == p] for p in ("build", "score"))
        if len(found) >= MIN_SAMPLES and score:
            row["baseline"] = row["ratio"] = ratio(score, None)
            for source, made in (("raw", b"".join(reversed(build))[:most]), ("cover", cover(build, counts, most))):
                if made and (got := ratio(score, made)) > row["ratio"]:
                    row |= {"source": source, "dictionary_bytes": len(made), "ratio": got, "kept": True, "dictionary": made}
        types = [key[0].type, pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.binary()]
        return pa.table([pa.array([v], t) for v, t in zip(row.values(), types)], names=list(row))

    return rows.groupBy("realm").cogroup(grams.groupBy("realm")).applyInArrow(train, out)
