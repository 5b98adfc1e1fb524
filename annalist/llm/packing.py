"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_array, slices, staged

CAPACITY = 2048
#: Items of an island, words that a worker remembers twice at most, about, and bytes of text that it takes at a time.
ISLAND, REMEMBERED, PART = 16_000, 300_000, 1_000_000
#: Capitals beyond ASCII are left alone, as a small form may end in a mark that belongs to what follows.
_AFTER_WORD = r"([\p{Ll}\p{Lm}\p{Lo}\p{N}])([!-/:-@\[-`{-~]+)(\s|$)"


class Words:
    """Token ids of words, remembered. Exact for a tokenizer that never joins across white space, that splits letters and
    digits from a closing run of ASCII punctuation and that marks the last token of a run of letters."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread would take memory of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if w.isalpha()]
        for a in range(0, len(plain), 500):  # one text of many words costs less than many texts
            part = plain[a : a + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part):
                raw, at = ids.tobytes(), [0, *(4 * cut).tolist()]
                self.young.update(zip(part, (raw[x:y] for x, y in zip(at[:-1], at[1:]))))
        rest = [w for w in new if w not in self.young]
        for a in range(0, len(rest), 500):
            part = rest[a : a + 500]
            self.young.update(zip(part, (np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's token ids, as unsigned little-endian 32-bit numbers."""
        found = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), _AFTER_WORD, r"\1 \2\3"))
        off = found.offsets.to_numpy().astype(np.int64)
        d = pc.dictionary_encode(found.flatten())
        known = d.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.young) > REMEMBERED:  # what isn't met again until the next time is forgotten
            self.old, self.young = self.young, {}
        missing = [w for w in known if w not in self.young]
        self.young.update((w, self.old.pop(w)) for w in missing if w in self.old)
        self._learn([w for w in missing if w not in self.young])
        of = [self.young[w] for w in known]
        which, at = d.indices.to_numpy(zero_copy_only=False).tolist(), (off - off[0]).tolist()
        return [b"".join(map(of.__getitem__, which[a:z])) for a, z in zip(at[:-1], at[1:])]


@lru_cache(1)
def _words(path: str) -> Words:
    return Words(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's token ids and an end id, cut at the capacity only where longer.

    The tokenizer is a path, read once by each worker. Null texts are empty: one piece of the end id alone. Rows are
    independent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        words, end = _words(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in batches:
            for b in slices(batch, "text", PART):
                rows, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(words.encode(as_array(b.column("text")))):
                    raw = ids + end
                    n = len(raw) // 4
                    for k, s in enumerate(range(0, n, capacity)):
                        e = min(n, s + capacity)
                        rows.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(raw[4 * s : 4 * e]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins of item lengths, found by free room: a bit mask says which rooms occur, so best fit takes one look."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.by_room, self.bins = capacity, 0, {}, []

    def open(self, items: list[int]) -> None:
        self._put(len(self.bins), self.capacity - sum(items))
        self.bins.append(items)

    def _put(self, i: int, room: int) -> None:
        self.by_room.setdefault(room, []).append(i)
        self.mask |= 1 << room

    def best_fit(self, n: int) -> None:
        rest = self.mask >> n
        if not rest:
            return self.open([n])
        room = n + (rest & -rest).bit_length() - 1
        at = self.by_room[room]
        i = at.pop()
        if not at:
            self.mask ^= 1 << room
        self.bins[i].append(n)
        self._put(i, room - n)


def _fitness(bins: list[list[int]], capacity: int) -> float:
    """Falkenauer's: the mean square of how full bins are."""
    return sum((sum(b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def _cross(a: list[list[int]], inject: list[list[int]], counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Put whole bins into a, remove a's bins that hold an item which they bring, and best-fit what these lose."""
    left = counts.copy()
    out = Bins(capacity)
    for b in inject:  # only as far as there are such items
        for n in b:
            left[n] -= 1
        if all(left[n] >= 0 for n in b):
            out.open(list(b))
        else:
            for n in b:
                left[n] += 1
    for b in a:
        for n in b:
            left[n] -= 1
        if all(left[n] >= 0 for n in b):
            out.open(list(b))
        else:
            for n in b:
                left[n] += 1
    for n in np.flatnonzero(left)[::-1].tolist():  # the displaced, longest first
        for _ in range(int(left[n])):
            out.best_fit(n)
    return out.bins


def evolve(lengths: np.ndarray, capacity: int, migrants: list[list[int]] = (), seed: int = 0, population: int = 4, generations: int = 6) -> list[list[int]]:
    """The best grouping found of an island's items: the bins, as lists of lengths."""
    rng = np.random.default_rng(seed)
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    bound = -(-int(lengths.sum()) // capacity)
    group = []
    for k in range(population):
        order = np.sort(lengths)[::-1] if k == 0 else np.sort(lengths * (1 + 0.15 * k * rng.random(len(lengths))))[::-1]
        if k:
            order = lengths[np.argsort(-(lengths * (1 + 0.15 * k * rng.random(len(lengths)))))]
        bins = Bins(capacity)
        for n in order.tolist():
            bins.best_fit(n)
        group.append(bins.bins)
    if migrants:
        group.append(_cross(group[0], list(migrants), counts, capacity))
    for _ in range(generations):
        group.sort(key=lambda g: (len(g), -_fitness(g, capacity)))
        if len(group[0]) <= bound:
            break
        del group[population:]
        for a, b in ((0, 1), (1, 0), (0, int(rng.integers(1, len(group))) if len(group) > 1 else 0)):
            full = [x for x in group[b] if sum(x) >= capacity - 2]
            take = [full[i] for i in rng.permutation(len(full))[: max(1, len(full) // 3)]]
            # a few poorly filled bins are dissolved too, so that their items meet others
            kept = sorted(group[a], key=sum, reverse=True)
            group.append(_cross(kept[: int(len(kept) * 0.9)], take, counts, capacity))
    return min(group, key=lambda g: (len(g), -_fitness(g, capacity)))


def _island(table: pa.Table, capacity: int, migrants: list[list[int]]) -> tuple[pa.Table, list[list[int]]]:
    """Places of an island's items: the table with bin and offset, and its bins."""
    lengths = table["length"].to_numpy()
    island = table["island"][0].as_py()
    bins = evolve(lengths, capacity, migrants, seed=int(island) % (1 << 31))
    order = np.lexsort((table["_tie"].to_numpy(), lengths))
    first = dict(zip(*(x.tolist() for x in np.unique(lengths[order], return_index=True))))
    number, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, b in enumerate(bins):
        at, total = 0, sum(b)
        for n in b:
            i = order[first[n]]
            first[n] += 1
            number[i], offset[i], fill[i] = k, at, total
            at += n
    out = {c: table[c] for c in table.column_names} | {"bin": pa.array(number), "offset": pa.array(offset), "fill": pa.array(fill)}
    return pa.table(out), bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, island: int = ISLAND, elite: int = 200) -> DataFrame:
    """Add sequence_id and offset: pieces grouped into as few sequences of at most capacity as found.

    Pieces are dealt at random to islands of about `island` items (so no key makes one larger). Each island evolves a
    grouping; then elite bins (full ones, as lists of lengths, at most `elite` an island) migrate to the next island,
    which evolves again with them, and the islands' poorly filled bins are dissolved into fewer
    islands and packed anew, until one is left or none fewer would do. Repeated rows are items of their own. A length over the capacity or under 1 raises an error. An empty
    table gives an empty one.
    """
    cols = pieces.columns
    wrong = F.expr(f"raise_error('a piece must have 1 to {capacity} tokens')")
    items = pieces.withColumn("length", F.when((F.col("length") >= 1) & (F.col("length") <= capacity), F.col("length")).otherwise(wrong.cast("long")))
    # written, so that the number which tells repeated rows apart stays the same whatever is computed again
    items = staged(items.withColumn("_tie", F.xxhash64(*[F.col(c) for c in cols], F.monotonically_increasing_id())))
    full = items.where(F.col("length") == capacity)
    rest = items.where(F.col("length") < capacity)
    n = rest.count()
    number = max(1, -(-n // island))
    rest = rest.withColumn("island", F.pmod(F.xxhash64("_tie", F.lit(1)), F.lit(number)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)

    def first(table: pa.Table) -> pa.Table:
        bins = _island(table, capacity, [])[1]
        best = [b for b in bins if sum(b) == capacity][:elite]
        return pa.table({"island": pa.array([(table["island"][0].as_py() + 1) % number]), "bins": pa.array([best], pa.list_(pa.list_(pa.int64())))})

    def settle(table: pa.Table, come: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({**{c: table[c] for c in table.column_names}, **{c: pa.array([], pa.int64()) for c in ("bin", "offset", "fill")}})
        migrants = come["bins"].to_pylist()[0] if len(come) else []
        return _island(table, capacity, migrants)[0]

    def again(table: pa.Table) -> pa.Table:
        return _island(table, capacity, [])[0]

    out = f"{schema}, bin long, offset long, fill long"
    if number > 1:
        migrants = rest.select("island", "length", "_tie").groupBy("island").applyInArrow(first, "island long, bins array<array<bigint>>")
        placed = rest.groupBy("island").cogroup(migrants.groupBy("island")).applyInArrow(settle, out)
    else:
        placed = rest.groupBy("island").applyInArrow(again, out)
    placed = staged(placed.withColumn("round", F.lit(0)))
    done, level = [], 0
    while number > 1:  # poorly filled bins are dissolved into fewer pools, as long as that leaves fewer
        loose = F.col("fill") < capacity - 8
        left = placed.where(loose).count()
        pools = max(1, -(-left // island))
        if not left or pools >= number:
            break
        done.append(placed.where(~loose))
        number, level = pools, level + 1
        pooled = placed.where(loose).drop("bin", "offset", "fill", "round").withColumn("island", F.pmod(F.xxhash64("_tie", F.lit(level + 1)), F.lit(number)))
        placed = staged(pooled.groupBy("island").applyInArrow(again, out).withColumn("round", F.lit(level)))
    done.append(placed)
    packed = done[0]
    for d in done[1:]:
        packed = packed.union(d)
    bits = (F.col("round") + 1) * F.lit(1 << 56) + F.col("island") * F.lit(1 << 20) + F.col("bin")
    packed = packed.select(*cols, bits.alias("sequence_id"), "offset")
    alone = full.select(*cols, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.union(alone)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """token_pieces() packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, tokenizer, capacity), capacity)
