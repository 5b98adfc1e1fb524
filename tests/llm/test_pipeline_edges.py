"""Each stage of the pipeline over odd documents: nulls in every column, empty and long texts, repeated rows, clashing columns, an empty table."""

import corpus_pipeline
import pytest
from annalist.llm.common import staged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, skey string, bucket long, score double, mix_p double, piece int, value string"
EXTRA = (1, "s", 2, 0.5, 0.1, 3, "v")
PROSE = "the quiet harbour keeps its boats in rows and every morning the fishermen mend their nets before the tide turns again "


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, "b", 4), (4, "one", "de", None, 3), (4, "one", "de", None, 3)]
    rows += [(5, PROSE * 8, "en", "a", len(PROSE) * 8), (6, PROSE * 8, "en", "b", None), (7, " ".join(f"w{i}" for i in range(60_000)), "en", "a", 1), (8, "x" * 200_000, "fr", "c", 200_000), (None, "a text without an id", "en", "a", 20)]
    rows += [(100 + i, f"document number {i} speaks of {chr(97 + i % 26) * 5} and of nothing else at all", ["en", "de"][i % 2], "abc"[i % 3], 60) for i in range(40)]
    return staged(spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_documents(spark, sf_dir, odd, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, odd, sf_dir)
    rows = out.collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd.select("doc_id").collect()}
        assert sum(r["length"] == 1 for r in rows) >= 3  # texts without a token are their end alone
        return
    assert out.columns == odd.columns and 0 < len(rows) <= odd.count()
    assert all(tuple(r)[5:] == EXTRA for r in rows)
    ids = [r["doc_id"] for r in rows]
    if name == "toxicity":
        assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())
    if name == "jaccard":
        assert ids.count(4) == 1 and 5 in ids and 6 not in ids and {1, 2, 3, 7, 8} <= set(ids) and ids.count(None) == 2
    if name == "suffixes":
        text = {r["doc_id"]: r["text"] for r in rows}
        assert len(rows) == odd.count() and text[1] is None and text[2] == "" and text[5] == text[6] == "" and len(text[7]) > 300_000 and text[8] == ""


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, sf_dir, odd, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, odd.limit(0), sf_dir)
    assert out.collect() == [] and (name == "packing" or out.columns == odd.columns)
