"""Source divergence audit: how each source's share of terms differs from the other sources of its language, and from the language.

Sort-based streaming: tasks turn their documents into runs sorted by (lang, term, source, document), the shuffle deals the runs by
(lang, term) and sorts them again, and a scan over runs of equal keys sums document frequency and counts. A second scan over the kept
terms emits partial sums for pairs of sources. A hot term or source is a row a task's batch, not a row a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_array, slices, staged

#: Documents of a language that a kept term has at least, ranks of terms, the scale and the smoothing of shares.
LEAST_DOCUMENTS, TERM_RANKS, SCALE, SMOOTH = 30, 50, 1_000_000_000, 5
RUNS = "lang string, term string, source string, document {id}, docs long, n long"
KEPT = "lang string, term string, source string, docs long, n long, first boolean, lang_n long"


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z in lower case: the text number of each, and all as one array."""
    texts = texts.cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    code = np.arange(256)
    table = np.where((code >= 65) & (code <= 90), code + 32, code).astype(np.uint8)
    inside = (((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122)) | (code >= 128))[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    first[heads] = inside[heads]  # a text's first byte begins a term whatever stands before it
    at = np.flatnonzero(first)
    length = np.bincount(np.cumsum(first, dtype=np.int32)[inside] - 1, minlength=len(at))
    bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    flat = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds.tobytes()), pa.py_buffer(table[data[inside]].tobytes()))
    return np.searchsorted(off, at, side="right") - 1, flat


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs (lang, term, source) of a part's documents: the first document, how many of them, how many occurrences."""
    for batch in batches:
        for part in slices(batch):
            doc, flat = terms(as_array(part.column("text")))
            if not len(flat):
                continue
            words = pc.dictionary_encode(flat)
            groups = list(zip(as_array(part.column("lang")).to_pylist(), as_array(part.column("source")).to_pylist()))
            names = {g: i for i, g in enumerate(dict.fromkeys(groups))}
            of = np.array([names[g] for g in groups])
            each, n = np.unique(doc * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)  # a document's terms
            doc, term = each // len(words.dictionary), each % len(words.dictionary)
            order = np.lexsort((doc, term, of[doc]))
            doc, term, n = doc[order], term[order], n[order]
            cut = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (of[doc[1:]] != of[doc[:-1]])]))
            docs = np.diff(np.append(cut, len(term)))
            langs, sources = (pa.array([g[k] for g in names]) for k in (0, 1))
            which = pa.array(of[doc[cut]])
            yield pa.RecordBatch.from_arrays(
                [langs.take(which), words.dictionary.take(pa.array(term[cut])).cast(pa.string()), sources.take(which), part.column("doc_id").take(pa.array(doc[cut])), pa.array(docs), pa.array(np.add.reduceat(n, cut))],
                ["lang", "term", "source", "document", "docs", "n"],
            )


def changes(table: pa.Table, *names: str) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns."""
    out = np.zeros(len(table), dtype=bool)
    if len(table):
        out[0] = True
        for name in names:
            col = table[name].combine_chunks()
            out[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
    return out


def whole_runs(batches: Iterator[pa.RecordBatch], fold, *key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys; what a batch leaves open is folded and carried on, so a run is held as its few folded rows."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = fold(table if held is None else pa.concat_tables([held, table]))
        cut = int(np.flatnonzero(changes(table, *key))[-1])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


def _folded(table: pa.Table) -> pa.Table:
    """Neighbouring rows of equal (lang, term, source) as one row with their sums."""
    cut = np.flatnonzero(changes(table, "lang", "term", "source"))
    sums = [pa.array(np.add.reduceat(table[c].to_numpy(), cut)) for c in ("docs", "n")]
    return pa.table([*[table[c].combine_chunks().take(pa.array(cut)) for c in ("lang", "term", "source")], *sums], names=["lang", "term", "source", "docs", "n"])


def _scan(least: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs((b.select(["lang", "term", "source", "docs", "n"]) for b in batches), _folded, "lang", "term"):
            first = changes(table, "lang", "term")
            cut = np.flatnonzero(first)
            of = np.cumsum(first) - 1
            keep = (np.add.reduceat(table["docs"].to_numpy(), cut) >= least)[of]
            total = np.add.reduceat(table["n"].to_numpy(), cut)[of]
            out = table.append_column("first", pa.array(first)).append_column("lang_n", pa.array(total)).filter(pa.array(keep))
            yield from out.combine_chunks().to_batches()

    return scan


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Occurrences by (lang, term, source) of the terms in at least so many documents of their lang; docs has doc_id, text, lang, source.

    first marks one row of each (lang, term), lang_n is the term's occurrences in the lang. A row of docs is a document.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = docs.select("doc_id", "text", "lang", "source").mapInArrow(_runs, RUNS.format(id=kind))
    dealt = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    return dealt.mapInArrow(_scan(least), KEPT)


def _share(n: str, total: str, v: str):
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * v)), in decimals, so that no count overflows."""
    top = (F.col(n) + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    low = (F.col(total) + SMOOTH * F.col(v)).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, low)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pairs of sources that share a run, what the run's sums over lone terms have too much or too little, summed over a batch.

    A run's rows stand together, so pairs are rows at a distance of 1, 2, ...; a carried run is its rows, one a source.
    """
    for table in whole_runs(batches, lambda t: t, "lang", "term"):
        run = np.cumsum(changes(table, "lang", "term"))
        group = pc.dictionary_encode(pa.chunked_array([pc.binary_join_element_wise(*[pc.replace_substring_regex(table[c].combine_chunks(), r"([\\|])", r"\\\1") for c in ("lang", "source")], "|")])).combine_chunks()
        code, p, p0 = group.indices.to_numpy(), table["p"].to_numpy(), table["p0"].to_numpy()
        many = len(group.dictionary)
        at_of = np.zeros(many, dtype=np.int64)
        at_of[code] = np.arange(len(code))
        found: list[np.ndarray] = []
        for d in range(1, int(np.bincount(run).max())):
            at = np.flatnonzero(run[d:] == run[:-d])
            b = at + d
            x, y, u, v = p[at], p[b], p0[at], p0[b]
            value = np.abs(x - y) - np.abs(x - v) - np.abs(y - u) + np.abs(u - v)
            key, inv = np.unique(code[at].astype(np.int64) * many + code[b], return_inverse=True)
            sums = np.zeros(len(key), dtype=np.int64)
            np.add.at(sums, inv, value)
            found.append(np.stack([key, sums]))
        if not found:
            continue
        pairs = np.concatenate(found, axis=1)
        key, inv = np.unique(pairs[0], return_inverse=True)
        sums = np.zeros(len(key), dtype=np.int64)
        np.add.at(sums, inv, pairs[1])
        a, b = pa.array(at_of[key // many]), pa.array(at_of[key % many])
        take = lambda c, at: table[c].combine_chunks().take(at)
        yield pa.RecordBatch.from_arrays([take("lang", a), take("source", a), take("source", b), pa.array(sums)], ["lang", "source", "item", "value"])


def audit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: how each (lang, source) differs from the lang's other sources and from the lang.

    Part "pair": every other source of the lang with the sum of differences of shares over the kept terms (0 without such terms).
    Part "term": the terms that the source uses more than the lang, up to a rank. Null text, lang and source count as ''; a row is a
    document, repeated ids included, null ids too; empty tables give no rows. All sums are whole numbers.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.coalesce(c, F.lit("")).alias(n) for c, n in ((F.col(text), "text"), (F.col(lang), "lang"), (F.col(source), "source"))])
    kept = staged(kept_terms(rows, least))
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum(F.when(F.col("first"), F.col("lang_n"))).alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    groups = groups.withColumn("zero", F.lit(0).cast("long"))
    groups = staged(groups.withColumn("p0", F.when(F.col("v") > 0, _share("zero", "total", "v")).otherwise(0)).drop("zero"))
    flat = staged(kept.join(groups, ["lang", "source"]).select("lang", "term", "source", "n", _share("n", "total", "v").alias("p"), "p0", _share("lang_n", "lang_total", "v").alias("q")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = flat.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    top = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    # sums over all kept terms: as if no term occurred, then terms of one side (by equal shares), then what terms of both sides change
    mine = groups.select("lang", "source", "v", "p0")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = mine.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("v") * F.abs(F.col("p0") - F.col("q0"))).alias("value"))
    shares = flat.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
    lone = shares.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (F.abs(F.col("p") - F.col("q0")) - F.abs(F.col("p0") - F.col("q0")))).alias("value"))
    shared = flat.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(_partial, "lang string, source string, item string, value long")
    shared = shared.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = base.union(lone).union(turned(lone)).union(shared).union(turned(shared)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.union(top)


def audit_sql(least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS) -> str:
    """DuckDB SQL of audit() over documents."""
    share = lambda n, total, v: f"cast(1 + (cast({SCALE} as hugeint) * ({n} + {SMOOTH})) // ({total} + {SMOOTH} * {v}) as bigint)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""with d as (select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
 w as (select r, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
 c as (select lang, term, source, count(distinct r) as docs, count(*) as n from w group by 1, 2, 3),
 k as (select lang, term, cast(sum(n) as bigint) as lang_n from c group by 1, 2 having sum(docs) >= {least}),
 l as (select lang, count(*) as v, cast(sum(lang_n) as bigint) as lang_total from k group by 1),
 g as (select lang, source, coalesce(total, 0) as total, coalesce(v, 0) as v, coalesce(lang_total, 0) as lang_total from (select distinct lang, source from d) left join (select lang, source, cast(sum(n) as bigint) as total from c join k using (lang, term) group by 1, 2) using (lang, source) left join l using (lang)),
 f as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, {share('coalesce(c.n, 0)', 'g.total', 'g.v')} as p, {share('k.lang_n', 'g.lang_total', 'g.v')} as q from g join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
 s as (select a.lang, a.source, b.source as item, cast(sum(abs(a.p - b.p)) as bigint) as value from f a join f b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
 o as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all select lang, source, 'term', term, p - q from f where n > 0 and p > q)
 select lang, source, part, item, value, cast(rank as integer) as rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from o) where part = 'pair' or rank <= {ranks}"""
