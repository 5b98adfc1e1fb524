"""Whitening against a dense eigensolver."""

import numpy as np
import pytest
from annalist.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=16):
    """(vec_id, x) of the rows that take part, n, deviations, whitened values and shares, by numpy."""
    ok = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in ok], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (fit * n - s) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    keep = e > 1e-12 * np.trace(v) * len(v)
    return [i for i, _ in ok], n, ((x * n - s) ** 2).sum(axis=1), ((x * n - s) / n) @ u[:, keep] / np.sqrt(e[keep]), e[keep] / np.trace(v)


def check(spark, rows, within=1e-8):
    ids, n, deviation, white, share = plain(rows)
    got = whitening.whitened(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).toPandas()
    assert len(got) == white.size and set(got.n) <= {n}
    if not len(got):
        return got
    assert (got.identity_error <= 1e-4).all() and (got.residual <= 1e-10).all() and got.identity_error.nunique() == 1
    table = got.pivot_table(index="vec_id", columns="component", values="whitened", aggfunc="first").loc[ids].to_numpy()
    sign = np.sign((table * white).sum(axis=0))
    assert np.abs(table - white * sign).max() < within
    assert got[got.component == 1].drop_duplicates("vec_id").set_index("vec_id").loc[ids].deviation.tolist() == deviation.tolist()
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, share, rtol=1e-9)
    return got


def test_the_table(spark, sf_dir):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(spark, rows)
    assert queries.op13_whitening(spark, sf_dir).columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_copies_nulls_and_others(spark):
    rng = np.random.default_rng(2)
    base = (rng.standard_normal((200, 12)) * np.arange(1, 13)).astype(np.float32).tolist()
    rows = list(enumerate(base)) + [(1000 + i, base[0]) for i in range(300)]
    rows += [(2000, None), (2001, [None] + base[1][1:]), (2002, [float("nan")] + base[1][1:]), (2003, [float("inf")] + base[1][1:]), (2004, [])]
    got = check(spark, rows)
    assert got.component.max() == 12 and set(got.n) == {200}
    assert not set(got.vec_id) & set(range(2000, 2005))


def test_few_vectors(spark):
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None, 0)], SCHEMA)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)).collect() == []
    rng = np.random.default_rng(3)
    got = check(spark, list(enumerate(rng.standard_normal((5, 40)).astype(np.float32).tolist())))
    assert got.component.max() == 4


def test_other_lengths_huge_entries_and_clashing_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v, 0) for i, v in enumerate(rng.standard_normal((50, 6)).astype(np.float32).tolist())]
    df = spark.createDataFrame([*rows, (900, [1.0, 2.0], 0), (901, [3e38] * 6, 0), (None, rows[0][1], 0)], SCHEMA).selectExpr("*", "1 as x", "2 as part", "'c' as component", "0 as n")
    got = whitening.whitened(df).toPandas()
    assert len(got) == 51 * 6 and not {900, 901} & set(got.vec_id.dropna()) and set(got.n) == {50}


@pytest.mark.parametrize("seed", range(4))
def test_lobpcg_finds_the_leading_vectors(seed):
    rng = np.random.default_rng(seed)
    d = (30, 200, 300, 120)[seed]
    e = np.sort((rng.random(d), rng.random(d) ** 4, 1 / np.arange(1, d + 1), np.concatenate([np.ones(20), np.zeros(100)]))[seed])[::-1]
    u = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = (u * e) @ u.T
    asked = []
    found, x, norms = whitening.lobpcg(lambda b: (asked.append(b.shape[1]), a @ b)[1], d, 16)
    assert np.allclose(found, e[:16], atol=1e-12) and norms.max() <= 1e-10 and np.abs(x.T @ x - np.eye(16)).max() < 1e-12
    assert max(asked) <= 48 and len(asked) < 200


def test_a_product_that_never_settles_is_an_error():
    rng = np.random.default_rng(0)
    with pytest.raises(ValueError, match="certified"):
        whitening.lobpcg(lambda b: rng.standard_normal(b.shape), 60, 16, passes=20)


def test_deviation_beyond_fast_whole_numbers(spark):
    v = np.random.default_rng(6).standard_normal((20, 3))
    v[0, 0], v[1, 0] = 2.2 * 2**19, -2.2 * 2**19
    rows = list(enumerate(v.astype(np.float32).tolist()))
    got = whitening.whitened(spark.createDataFrame([(i, r, 0) for i, r in rows], SCHEMA)).where("component = 1").orderBy("vec_id").collect()
    assert [r.deviation for r in got] == [sum(int(c) ** 2 for c in d) for d in plain_differences(rows)]


def plain_differences(rows):
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows]
    return [[len(x) * c - sum(column) for c, column in zip(v, zip(*x))] for v in x]


def test_a_deviation_that_is_no_long_is_an_error(spark):
    v = np.random.default_rng(6).standard_normal((20, 3)) * 2.0**22
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(spark.createDataFrame([(i, r, 0) for i, r in enumerate(v.astype(np.float32).tolist())], SCHEMA)).collect()
