"""A corpus from raw documents to tokens: five operators of plumbline.llm, one after another."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bytebpe, golay, mixing, pii, toxicity
from plumbline.llm.common import read, settle
from plumbline.llm.queries import BYTE_BPE, WEIGHTS

# Of all tokens that reach the mixture, the share that it takes.
MIX_SHARE = (4, 5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays."""
    return golay.keep_first(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of their sources; a document stands once per epoch that holds it."""
    return mixing.mix(docs, WEIGHTS, MIX_SHARE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, their number, and digests of the ids and of the decoded bytes."""
    return bytebpe.encode_documents(docs, BYTE_BPE, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("byte-level bpe", encode),
]

# The classifier, the fingerprints and the tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
