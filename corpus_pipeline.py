"""A training-data pipeline of five stages: documents in, packed sequences out.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import _base, exact_dedup, packing, rlz_dedup, simhash_dedup, toxicity

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the classifier learns from the labelled ones that aren't held out. Null texts count as empty."""
    return toxicity.accepted(docs, toxicity.train(docs, _base.table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: that of the smallest id; null and empty texts are one group."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked fingerprints: that of the smallest id; texts without words are one class."""
    return simhash_dedup.one_of_each(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut out; documents of which nothing is left go, empty ones stay."""
    out = rlz_dedup.without_passages(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens, with their ids."""
    return packing.packing(docs, public_tokenizers.path(TOKENIZER), keep_ids=True)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("substring dedup", cut_passages), ("packing", pack)]

#: The classifier, the suffix index and the packing can't be told in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; a stage's table and all that the stage spilled are deleted once the next one is written."""
    docs, before = _base.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with _base.scope() as spilled:
            docs = _base.spill(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            spilled.pop()  # the stage's own table
        _base.forget(*before)
        before = [docs]
    return docs
