"""The divergence audit against its SQL and a plain version."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from annalist.llm import divergence, queries

from oracle import both, connection

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least, ranks=50):
    """The audit by loops over all terms and groups."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda n, all_: 1 + (1_000_000_000 * (n + 5)) // (all_ + 5 * v)
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        for s in sources:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, math.inf), ("term", term, ranks)):
                for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1):
                    if k <= most:
                        out.add((lang, s, part, item, value, k))
    return out


def rows_of(df):
    return {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()}


def test_same_as_sql(spark, sf_dir):
    got, wanted = both(queries.op11_divergence(spark, sf_dir), connection(sf_dir), queries.ORACLE_SQL["op11_divergence"])
    assert got == wanted and len(got[1]) > 0


@pytest.mark.parametrize("seed", range(3))
def test_same_as_plain(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b|c", "b\\", "é", None, ""]
    words = ["The", "the", "çà", "x", "y1z", "[q]", "日本", "naïve", "end."] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(rng.randrange(40), " ".join(rng.choices(words, k=rng.randrange(30))) if rng.random() < 0.9 else None, rng.choice(["en", "de", None]), rng.choice(names)) for _ in range(200)]
    rows += [(1, "the the hot", "en", "hot")] * 150
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(7), least=5, ranks=4)
    assert rows_of(got) == plain(rows, 5, 4)


def test_edges(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, None, None, None), (1, "", "en", "a"), (1, "1 2 \x00\x7f", "en", "b"), (2, "word " * 100_000 + "Ω" * 50_000, "en", "a")]
    assert rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA), least=1)) == plain(rows, 1)
    nothing_kept = rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA), least=30))
    assert nothing_kept == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_clashing_columns(spark):
    rows = [(i, f"alpha beta {'gamma' if i % 2 else 'delta'}", "en", f"s{i % 3}") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("term", "n", "p", "document", "value", "rank", "part", "zero", "v", "total"):
        df = df.selectExpr("*", f"'x' as `{name}`")
    assert rows_of(divergence.audit(df, least=3)) == plain(rows, 3)
