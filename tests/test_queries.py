"""Every history query against its SQL, and those without SQL against what must hold."""

import pytest
from annalist.plans.upkeep import ORACLE_SQL, QUERIES

from oracle import both, connection


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, con, name):
    got, wanted = both(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name])
    assert got[0] == wanted[0]
    assert got[1] == wanted[1]


def test_chunks_reassemble(spark, sf_dir):
    import hashlib

    texts = {r[0]: (r[1] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    at: dict = {}
    for r in sorted(QUERIES["content_chunks"](spark, sf_dir).collect(), key=lambda r: (r["key"], r["idx"])):
        assert r["start"] == at.get(r["key"], 0) and 0 < r["length"] <= 4 * 4096
        piece = texts[r["key"]][r["start"] : r["start"] + r["length"]]
        assert hashlib.sha256(piece).hexdigest() == r["hash"]
        at[r["key"]] = r["start"] + r["length"]
    assert all(at.get(k, 0) == len(t) for k, t in texts.items())


def test_flush_batches_cover_the_journal(spark, sf_dir):
    from annalist.sources.history import ops

    rows = QUERIES["flush_batches"](spark, sf_dir).collect()
    assert sum(r["operations"] for r in rows) == ops(spark, sf_dir).count()
    assert all(r["first_sequence"] <= r["last_sequence"] for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_adapters_prune_columns(spark, sf_dir):
    from annalist.sources.history import provider_stat

    plan = provider_stat(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan.split("ReadSchema")[1]
