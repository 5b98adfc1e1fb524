"""Mixing sources to target weights by iterative proportional fitting (raking).

Built from DataFrame functions only. Documents are first summed to cells (one for each source, language and topic),
which is the only pass over all rows before the sample; the raking loop works on the cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, staged

#: What counts as white space between words.
SPACES = " \n\t\r"


def token_count(text: Column) -> Column:
    """Words between spaces: the number of white-space characters plus one; 0 for null or empty texts."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.length(text) - F.length(F.translate(text, SPACES, "")) + 1).cast("long")


def with_topic(docs: DataFrame, text: Column, name: str = "_topic", topics: int = 8) -> DataFrame:
    """docs with a stand-in for a topic label: words are dealt to classes by their second and fifth letters, and the class that
    most of the text's plain words of six letters or more are in is its topic (the least of equal ones; -1: no such word).

    Each step is a column of its own that the next one uses several times, so that no step is computed again and again.
    """
    letter = lambda w, n: F.ascii(F.substring(w, n, 1))
    of_class = lambda k: F.size(F.filter("_mix_classes", lambda c: c == k))
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{6,}"), F.lit(0))
    out = docs.withColumn("_mix_classes", F.transform(words, lambda w: (letter(w, 2) * 7 + letter(w, 5)) % topics))
    out = out.withColumn("_mix_counts", F.array(*map(of_class, range(topics))))
    most = F.array_max("_mix_counts")
    topic = F.when(most == 0, F.lit(-1)).otherwise(F.array_position("_mix_counts", most) - 1).cast("int")
    return out.withColumn(name, topic).drop("_mix_classes", "_mix_counts")


def unit(key: Column) -> Column:
    """A number in [0, 1) that depends on the key only."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares of a marginal: its observed token share to the given power, normed. 1 keeps it, 0 makes it even."""
    mass = cells.groupBy(dim).agg(F.sum("_n").alias("_m")).where("_m > 0").withColumn("_p", F.pow(F.col("_m").cast("double"), F.lit(power)))
    total = mass.agg(F.sum("_p").alias("_t"))
    return mass.crossJoin(F.broadcast(total)).select(dim, (F.col("_p") / F.col("_t")).alias("_share"))  # the right side is one row


def rake(cells: DataFrame, targets: dict[str, DataFrame], budget: float, rounds: int = 12, cut: int = 3) -> DataFrame:
    """Weights of cells whose marginals have the target shares.

    cells: one row per cell, with _n (tokens) and the dimensions. targets: by dimension, rows (dimension, _share).
    budget: the tokens asked for, as a share of all tokens. Each round scales the cells dimension by dimension and then
    bounds them by what they hold, so that no cell asks for more than its documents; the others make up for it in the
    next round. Adds _w (tokens wanted). Every cut rounds the lineage is cut by writing the cells.
    """
    from pyspark.sql import Window

    total = cells.agg(F.sum("_n").cast("double").alias("_total"))
    out = cells.crossJoin(F.broadcast(total)).withColumn("_w", F.col("_n") * F.lit(float(budget)))
    for dim, share in targets.items():
        share = share.withColumnRenamed("_share", f"_share_{dim}")
        out = out.join(F.broadcast(share) if small(share) else share, out[dim].eqNullSafe(share[dim]), "left").drop(share[dim])
    for r in range(rounds):
        for dim in targets:
            got = F.sum("_w").over(Window.partitionBy(dim))
            want = F.col(f"_share_{dim}") * F.col("_total") * F.lit(float(budget))
            out = out.withColumn("_w", F.when(got > 0, F.col("_w") * want / got).otherwise(F.lit(0.0)))
        out = out.withColumn("_w", F.least(F.col("_w"), F.col("_n").cast("double")))
        if (r + 1) % cut == 0:
            out = staged(out)
    return out.select(*cells.columns, "_w")


def mix_documents(docs: DataFrame, dims: dict[str, Column], tokens: Column, key: Column, budget: float = 0.5, power: float = 0.5, targets: dict[str, DataFrame] | None = None, rounds: int = 12) -> DataFrame:
    """Sample documents so that the tokens of each source, language, topic come near target shares.

    dims: marginal name to column. targets: by name, rows (name, _share); where a marginal has none, its observed share
    to the given power. A document is kept if a number in [0, 1) that depends on its key only is below the probability
    of its cell (tokens wanted over tokens there). Adds mix_tokens, mix_<dim> and mix_p; the columns of docs stay, and
    may have any other names. Nulls in a dimension form a cell of their own. Documents without tokens are in a cell
    but weigh nothing; a cell of such documents alone has probability 0. Repeated rows share one fate. An empty table
    gives an empty one. The cells are broadcast if at most 20,000, else joined with the hot ones dealt out by salt.
    """
    names = {k: f"mix_{k}" for k in dims}
    tagged = docs.withColumns({**{names[k]: c for k, c in dims.items()}, "mix_tokens": tokens})
    cells = staged(tagged.groupBy(*names.values()).agg(F.sum("mix_tokens").alias("_n")))
    given = {names[k]: v.withColumnRenamed(k, names[k]) for k, v in (targets or {}).items()}
    want = {d: given.get(d) if d in given else tempered(cells, d, power) for d in names.values()}
    cells = rake(cells, want, budget, rounds).withColumn("mix_p", F.when(F.col("_n") > 0, F.col("_w") / F.col("_n")).otherwise(F.lit(0.0)))
    cells = staged(cells.select(*[F.col(d).alias(f"_c_{d}") for d in names.values()], "mix_p"))
    same = [F.col(d).eqNullSafe(F.col(f"_c_{d}")) for d in names.values()]
    if small(cells):
        out = tagged.join(F.broadcast(cells), reduce(lambda a, b: a & b, same))
    else:
        salts = 64
        out = tagged.withColumn("_salt", F.pmod(F.hash(key), F.lit(salts))).join(cells.withColumn("_c_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), reduce(lambda a, b: a & b, [*same, F.col("_salt") == F.col("_c_salt")])).drop("_salt", "_c_salt")
    return out.where(unit(key) < F.col("mix_p")).drop(*[f"_c_{d}" for d in names.values()])


def corpus_mix(docs: DataFrame, budget: float = 0.5, power: float = 0.5) -> DataFrame:
    """mix_documents() over source, language and topic (see with_topic()), with word counts as tokens."""
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col("_topic")}
    return mix_documents(with_topic(docs, F.col("text")), dims, token_count(F.col("text")), F.col("doc_id"), budget, power).drop("_topic")


def _sql_rounds(rounds: int, budget: float) -> str:
    steps, last = [], "w0"
    for r in range(rounds):
        for i, d in enumerate(("source", "lang", "topic")):
            name = f"w{r * 3 + i + 1}"
            capped = "least({}, n)" if d == "topic" else "{}"
            value = f"case when sum(w) over (partition by {d}) > 0 then w * share_{d} * total * {budget} / sum(w) over (partition by {d}) else 0 end"
            steps.append(f"{name} as materialized (select * replace ({capped.format(value)} as w) from {last})")
            last = name
    return ",\n".join(steps) + f",\nfitted as (select source, lang, topic, case when n > 0 then w / n else 0 end as p from {last})"


def mix_sql(table: str = "documents", columns: str = "doc_id, source as mix_source, lang as mix_lang, topic as mix_topic, tokens as mix_tokens, round(p, 6) as mix_p", budget: float = 0.5, power: float = 0.5, rounds: int = 12) -> str:
    """DuckDB SQL for corpus_mix()."""
    spaces = "chr(32) || chr(10) || chr(9) || chr(13)"
    shares = ", ".join(f"s_{d} as (select {d}, pow(sum(n), {power}) / sum(pow(sum(n), {power})) over () as share_{d} from cells group by {d} having sum(n) > 0)" for d in ("source", "lang", "topic"))
    joins = " ".join(f"left join s_{d} on cells.{d} is not distinct from s_{d}.{d}" for d in ("source", "lang", "topic"))
    return f"""
with tagged0 as (select *, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{6,}}'), lambda w: (ascii(substr(w, 2, 1)) * 7 + ascii(substr(w, 5, 1))) % 8) as classes from {table}),
tagged1 as (select *, list_transform(range(8), lambda t: len(list_filter(classes, lambda c: c = t))) as counts from tagged0),
tagged as (select *, case when len(classes) = 0 then -1 else list_position(counts, list_max(counts)) - 1 end as topic,
  case when coalesce(length(text), 0) = 0 then 0 else length(text) - length(translate(text, {spaces}, '')) + 1 end as tokens from tagged1),
cells as materialized (select source, lang, topic, cast(sum(tokens) as double) as n from tagged group by all),
{shares},
w0 as materialized (select cells.*, share_source, share_lang, share_topic, (select sum(n) from cells) as total, n * {budget} as w from cells {joins}),
{_sql_rounds(rounds, budget)}
select {columns} from (select t.*, f.p from tagged t join fitted f on t.source is not distinct from f.source and t.lang is not distinct from f.lang and t.topic = f.topic)
where cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8)) as bigint) / 4294967296.0 < p"""
