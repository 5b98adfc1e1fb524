"""Toxic spans by a linear-chain conditional random field, document scores from its marginals.

The chain has two states, clean (0) and toxic (1). It is fitted on a bounded sample of labelled documents, whose tokens
are labelled from the documents' labels: a token of a toxic document counts as toxic if its form, or an affix of it, is
found in toxic documents far more often than chance allows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_array, mix, shingle_hashes, slices, words

#: The sample that the field is fitted on: documents of either label and characters of one, at most. Features kept at most.
SAMPLE_DOCS, SAMPLE_CHARS, FEATURES = 3000, 20_000, 50_000
#: Probabilities of being toxic that don't count towards a document's score.
FLOOR = 0.1
#: Words that a task remembers the score of, and bytes of text that it takes at a time.
REMEMBERED, PART = 250_000, 2_000_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def features(word: str) -> list[str]:
    """A word's form and affixes, without punctuation at its ends."""
    w = _EDGES.sub("", word)
    if not w:
        return []
    return ["=" + w, *("<" + w[:n] for n in range(3, 7) if len(w) > n), *(">" + w[-n:] for n in range(3, 7) if len(w) > n)]


@dataclass
class Field:
    """weights: by feature, for state 1. bias: of state 1. step: log potentials from state to state. link: of the document score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    link: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))


def _order(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.diff(off)
    by = np.argsort(-size, kind="stable")
    return by, off[:-1][by], size[by]


def marginals(e: np.ndarray, off: np.ndarray, step: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over many chains at once: P(state 1) of each token, and (if asked for) P(1, 1) with the token before it.

    e: log potential of state 1 over state 0 of each token, chain after chain. The messages are kept as log ratios
    of the states, so one number a token.
    """
    by, start, size = _order(off)
    longest = int(size[0]) if len(size) else 0
    fwd, bwd = np.zeros(len(e)), np.zeros(len(e))
    live = np.searchsorted(-size, -np.arange(longest), side="left")  # chains longer than t
    s00, s01, s10, s11 = np.exp(step.ravel())
    r = np.zeros(0)
    for t in range(longest):
        n = live[t]
        at = start[:n] + t
        if t:
            x = np.exp(np.clip(r[:n], -500, 500))
            r = e[at] + np.log((s01 + s11 * x) / (s00 + s10 * x))
        else:
            r = e[at]
        fwd[at] = r
    r = np.zeros(len(size))
    for t in range(longest - 2, -1, -1):
        n = live[t + 1]
        at = start[:n] + t
        x = np.exp(np.clip(e[at + 1] + r[:n], -500, 500))
        r[:n] = np.log((s10 + s11 * x) / (s00 + s01 * x))
        bwd[at] = r[:n]
    p = 1 / (1 + np.exp(-np.clip(fwd + bwd, -500, 500)))
    if not pairs:
        return p, None
    pair = np.zeros(len(e))
    inner = np.ones(len(e), dtype=bool)
    inner[off[:-1][np.diff(off) > 0]] = False
    i = np.flatnonzero(inner)
    with np.errstate(over="ignore"):
        one = np.exp(np.clip(e[i] + bwd[i], -500, 500))  # state 1 here over state 0, seen from the right
        before = np.exp(np.clip(fwd[i - 1], -500, 500))
        table = np.stack([s00 * np.ones(len(i)), s01 * one, s10 * before, s11 * before * one])
        pair[i] = table[3] / table.sum(axis=0)
    return p, pair


def _originals(texts: pa.Array, functions: int = 6, part: int = 500) -> list[int]:
    """Places of texts that share no min-hash of their 5-word shingles with an earlier one: copies would pass for evidence."""
    seen, out = set(), []
    for a in range(0, len(texts), part):
        off, h = shingle_hashes(texts.slice(a, part))
        full = np.flatnonzero(np.diff(off))
        least = [np.minimum.reduceat(mix(h ^ np.uint64(7919 * f + 1)), off[:-1][full]).tolist() for f in range(functions)] if len(full) else []
        for i, keys in zip((full + a).tolist(), zip(*least)):
            if not any((f, k) in seen for f, k in enumerate(keys)):
                out.append(i)
            seen.update(enumerate(keys))
    return out


class _Features:
    """The features of a vocabulary as numbers: those of word i are ids[off[i] : off[i + 1]]."""

    def __init__(self, vocabulary: list[str]):
        number: dict[str, int] = {}
        rows = [[number.setdefault(f, len(number)) for f in features(w)] for w in vocabulary]
        self.names = list(number)
        self.off = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
        self.ids = np.fromiter((i for r in rows for i in r), dtype=np.int32, count=self.off[-1])

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of words, one after another: which of the words each belongs to, and its number."""
        n = self.off[words + 1] - self.off[words]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - self.off[words], n)
        return np.repeat(np.arange(len(words)), n), self.ids[at]


def fit(texts: list[str], labels: list[int], seed: int = 5, epochs: int = 12, rate: float = 0.3) -> Field:
    """A field from documents and their labels. With one label only it scores all documents by that label's share."""
    out, label = Field(), np.array(labels, dtype=np.int64)
    bad, n = int(label.sum()), len(label)
    if not bad or bad == n:
        share = (bad + 0.5) / (n + 1) if n else 0.01
        out.link = (float(np.log(share / (1 - share))), 0.0, 0.0)
        return out
    column = pa.array(texts, pa.string())
    single = _originals(column)
    off, flat = words(column)
    coded = pc.dictionary_encode(flat)
    ids, vocabulary = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    del column, flat, coded
    known = _Features(vocabulary)
    seen, toxic = np.zeros(len(known.names), np.int64), np.zeros(len(known.names), np.int64)
    for i in single:
        found = np.unique(known.of(np.unique(ids[off[i] : off[i + 1]]))[1])
        seen[found] += 1
        toxic[found] += label[i]
    bad, n = int(label[single].sum()), len(single)
    pi = max(1, bad) / max(1, n)
    # nats by which a feature's share of toxic documents beats the base rate, times its documents (0 if it falls short)
    q = toxic / np.maximum(seen, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = seen * (q * np.log(q / pi) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - pi)), 0))
    evidence = np.where(q > pi, evidence, 0.0)
    ranked = np.argsort(-evidence, kind="stable")[: int(min(FEATURES, (evidence > 3).sum()))]
    place = np.full(len(seen), -1)
    place[ranked] = np.arange(len(ranked))
    sure = np.log(10 * max(1, int((seen > 0).sum())))  # so that chance gives a tenth of a strong feature among all
    strong = (place >= 0) & (evidence > sure) & (q > 0.5 + pi / 2) & (toxic / max(1, bad) > 20 * (seen - toxic) / max(1, n - bad))
    of, which = known.of(np.arange(len(vocabulary)))
    marked = np.bincount(of, weights=strong[which], minlength=len(vocabulary)) > 0
    # training chains: runs of 24 tokens with a toxic one, and as many again and more without
    rng = np.random.default_rng(seed)
    tags = marked[ids] & np.repeat(label == 1, np.diff(off))
    count = -(-np.diff(off) // 24)
    doc = np.repeat(np.arange(len(count)), count)
    start = off[:-1][doc] + 24 * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    end = np.minimum(start + 24, off[1:][doc])
    hot = np.maximum.reduceat(tags.view(np.uint8), start) > 0 if len(start) else np.zeros(0, dtype=bool)
    chains = rng.permutation(np.flatnonzero(hot | (rng.random(len(start)) < 0.15 * (1 - 0.7 * label[doc]))))[:40_000]
    w, bias, step = np.zeros(len(ranked)), -3.0, np.zeros((2, 2))
    gw, gb, gs = np.full(len(ranked), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(epochs):
        for a in range(0, len(chains), 2000):
            part = chains[a : a + 2000]
            size = end[part] - start[part]
            ends = np.concatenate([[0], np.cumsum(size)])
            at = np.arange(ends[-1]) - np.repeat(ends[:-1] - start[part], size)
            y = tags[at].astype(float)
            rows, cols = known.of(ids[at])
            rows, cols = rows[place[cols] >= 0], place[cols][place[cols] >= 0]
            e = bias + np.bincount(rows, weights=w[cols], minlength=len(y))
            p, pair = marginals(e, ends, step)
            inner = np.ones(len(y), dtype=bool)
            inner[ends[:-1]] = False
            i = np.flatnonzero(inner)

            def moments(q: np.ndarray, both: np.ndarray) -> np.ndarray:
                one, two = q[i - 1].sum(), q[i].sum()
                return np.array([[len(i) - one - two + both, two - both], [one - both, both]])

            slope = y - p
            dw = np.bincount(cols, weights=slope[rows], minlength=len(w)) - 0.05 * w
            db, ds = slope.sum(), moments(y, (y[i - 1] * y[i]).sum()) - moments(p, pair[i].sum()) - 0.05 * step
            gw, gb, gs = gw + dw**2, gb + db**2, gs + ds**2
            w, bias, step = w + rate * dw / np.sqrt(gw), bias + rate * db / np.sqrt(gb), step + rate * ds / np.sqrt(gs)
    out.weights = {known.names[f]: float(x) for f, x in zip(ranked.tolist(), w) if abs(x) > 1e-3}
    out.bias, out.step = float(bias), step
    # the document score: a logistic function of the expected number of toxic tokens, from those above FLOOR, and of the surest one
    emission = np.array([out.emission(x) for x in vocabulary])
    total, top = np.zeros(len(label)), np.zeros(len(label))
    cut = [0, *(np.flatnonzero(np.diff(off[1:] // 300_000)) + 1).tolist(), len(label)]  # parts of about so many tokens
    for a, z in zip(cut[:-1], cut[1:]):
        part = off[a : z + 1] - off[a]
        total[a:z], top[a:z] = _sums(marginals(emission[ids[off[a] : off[z]]], part, step, False)[0], part)
    x = np.stack([np.ones(len(label)), np.log1p(total), top], axis=1)
    y, beta = label.astype(float), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(3)
        beta = beta + np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.1 * beta), -5, 5)
        beta[1:] = np.maximum(beta[1:], 0)  # more toxic tokens never lower a score, so that an empty text has the least
    out.link = tuple(float(b) for b in beta)
    return out


def _sums(p: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # what is below FLOOR is no evidence, or a long text would gather it
    total = np.diff(np.concatenate([[0.0], np.cumsum(np.maximum(p - FLOOR, 0))])[off])
    top = np.zeros(len(off) - 1)
    if len(p):
        full = np.diff(off) > 0
        top[full] = np.maximum.reduceat(p, off[:-1][full])
    return np.maximum(total, 0), top


def _sample(docs: DataFrame, labels: DataFrame, held_out, id_col: str, text_col: str, label_col: str, per_label: int, chars: int) -> DataFrame:
    """(_t, _y, _o): texts and labels of the sample, and what it is in order of."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    one = one.where(~held_out(F.col(id_col)))
    order = F.xxhash64(id_col)
    picked = [one.where(F.col("_y") == y).orderBy(order, id_col).limit(per_label) for y in (0, 1)]
    ids = picked[0].union(picked[1])
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t")).where(F.length("_t") <= chars).join(F.broadcast(ids), id_col)  # at most 2 * per_label rows
    return rows.dropDuplicates([id_col]).select("_t", "_y", order.alias("_o"))


def labelled_sample(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """At most per_label documents of either label that aren't held out and have at most `chars` characters, in order of a hash of the id."""
    got = _sample(docs, labels, held_out, id_col, text_col, label_col, per_label, chars).orderBy("_o").toArrow()
    return got["_t"].to_pylist(), got["_y"].to_pylist()


def fitted(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Field:
    """fit() of labelled_sample(), in a task: the bounded sample stays off the driver, which gets the field of at most FEATURES weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches([b.select(["_t", "_y"]) for b in batches], pa.schema([("_t", pa.string()), ("_y", pa.int32())]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(got["_t"].to_pylist(), got["_y"].to_pylist()))], pa.binary())], names=["field"])

    sample = _sample(docs, labels, held_out, id_col, text_col, label_col, per_label, chars).withColumn("_y", F.col("_y").cast("int"))
    row = sample.repartition(1).sortWithinPartitions("_o").mapInArrow(run, "field binary").first()
    return pickle.loads(row["field"]) if row else fit([], [])  # an empty sample may have no task at all


def _marginals_of(m: Field, texts: pa.Array, memo: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its score, and of its tokens (with offsets) the probability of being toxic. memo: scores of the task's words so far."""
    found = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    off = found.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    d = pc.dictionary_encode(found.flatten())
    known = d.dictionary.to_pylist()
    if len(memo) > REMEMBERED:
        memo.clear()
    for w in known:
        if w not in memo:
            memo[w] = m.emission(w)
    e = np.array([memo[w] for w in known])[d.indices.to_numpy(zero_copy_only=False)] if len(d) else np.zeros(0)
    p, _ = marginals(e, off, m.step, False)
    total, top = _sums(p, off)
    z = m.link[0] + m.link[1] * np.log1p(total) + m.link[2] * top
    return 1 / (1 + np.exp(-z)), off, p


def score_documents(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """(doc_id, score, spans) of every whole text; spans: [start, end) code points of words that are toxic with probability of at least cut.

    A null or empty text has the score of no toxic token and no spans. A text is one chain however long. Rows are
    independent: repeated ones get equal scores; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            for b in slices(batch, "text", PART):
                texts = as_array(b.column("text"))
                score, off, p = _marginals_of(shared.value, texts, memo)
                spans: list[list[dict]] = [[] for _ in range(len(texts))]
                for i in np.unique(np.searchsorted(off, np.flatnonzero(p >= cut), side="right") - 1):
                    text = texts[i].as_py()
                    places = [(x.start(), x.end()) for x in re.finditer(r"\S+", text)]
                    hot = p[off[i] : off[i + 1]] >= cut
                    if len(places) != len(hot):  # white space at an end of the text adds an empty word there
                        hot = hot[1:] if text[:1].isspace() else hot
                    spans[i] = [{"start": s, "end": t} for (s, t), h in zip(places, hot) if h]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start:bigint,end:bigint>>")


def clean_documents(docs: DataFrame, model: Field, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is under the threshold; null and empty texts as in score_documents()."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            for b in slices(batch, text_col, PART):
                score = _marginals_of(shared.value, as_array(b.column(text_col)), memo)[0]
                yield b.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
