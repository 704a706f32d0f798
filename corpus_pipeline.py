"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.llm.bpe import default_vocabulary, token_digests
from palisade.llm.common import documents, materialize
from palisade.llm.jaccard import deduplicate_similar
from palisade.llm.mixing import mixed_documents
from palisade.llm.pii import mask_pii
from palisade.llm.quality import keep_good, labels_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; its labels are those of the labels table, without the held-out rows."""
    return keep_good(docs, labels_table(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id.

    Near copies are similar to 0.8 or more in their shingles of five words.
    """
    return deduplicate_similar(docs, width=5)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked by kind; n_chars follows."""
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document with the number and digests of its tokens and of the decoded text."""
    return token_digests(docs, default_vocabulary())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("bpe", bpe)]

#: SQL can express neither the classifier nor the fingerprints; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
