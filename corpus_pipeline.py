"""The corpus pipeline: documents are filtered, deduplicated, cut, mixed and packed.

Each stage takes (spark, docs, sf_dir) and is one operator of annalist.llm with its production parameters. Null texts count as empty and
stay null, null ids stay, other columns may have any names and pass through, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annalist.llm import jaccard, mixing, packing, suffix, toxicity
from annalist.llm.common import staged
from annalist.llm.queries import table, tokenizer_path

#: No SQL expresses the conditional random field or the packing; tests hold each stage against a plain version.
ORACLE_SQL = None


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes for what the session runs from here on: rows hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3. A text without a word has the least score; without labels all documents score by a fixed share and stay."""
    _small_batches(spark)
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"), toxicity.held_out)
    return toxicity.clean_documents(docs, model, 0.3)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 or more connect, that of the least id; texts without a word are in no group."""
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 400-byte strings that occur elsewhere; a text that repeats as a whole becomes empty, its row stays."""
    _small_batches(spark)
    return suffix.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics come near their target weights; null ones are a source and a language of their own."""
    used = ("doc_id", "text", "lang", "source", "n_chars")
    own = docs.toDF(*[c if c in used else f"own_{i}" for i, c in enumerate(docs.columns)])  # other columns may have any names
    return mixing.corpus_mix(own).select(*own.columns).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; a text without a token is one piece, its end."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("jaccard", keep_one_of_similar), ("suffixes", cut_repeats), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
