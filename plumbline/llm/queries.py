"""The operators of this package as queries over the whole test tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import (
    arrowids, bytebpe, chat, chunks, fixity, golay, manifest, maxscore, mixing, pii, shards, toxicity, whitening,
)
from plumbline.llm.common import read

# Where the vocabularies are; the operators take the path as a parameter.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
END_ID = 2
# Target weights by path or name; names without one weigh mixing.DEFAULT_WEIGHT.
WEIGHTS = {"d0": 400, "d1": 300, "d2": 200, "en": 300, "d1/de": 50, "src0": 50}
SHARE = (1, 2)  # of all tokens that is taken


def op1_pii(spark: SparkSession, directory: str) -> DataFrame:
    return pii.find(read(spark, directory, "documents")).drop("text_hash")


def op2_maxscore(spark: SparkSession, directory: str) -> DataFrame:
    return maxscore.search_embeddings(read(spark, directory, "embeddings"))


def op3_arrow_ids(spark: SparkSession, directory: str) -> DataFrame:
    return arrowids.token_ids(read(spark, directory, "documents"), WORD_BPE, END_ID, special=True)


def op4_simhash(spark: SparkSession, directory: str) -> DataFrame:
    return golay.near_duplicates(read(spark, directory, "documents"))


def op5_fixity(spark: SparkSession, directory: str) -> DataFrame:
    """The pages as WARC records, against a replica with damaged and lost records."""
    records = fixity.warc_records(read(spark, directory, "pages"))
    replica = fixity.place(fixity.damage(records, F.col("page_id") % 7 == 3))
    return fixity.audit(fixity.place(records), replica.where("page_id IS NULL OR page_id % 41 <> 5"))


def op6_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.toxicity(read(spark, directory, "documents"), read(spark, directory, "labels"))


def op7_byte_bpe(spark: SparkSession, directory: str) -> DataFrame:
    return bytebpe.encode_documents(read(spark, directory, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op8_chat(spark: SparkSession, directory: str) -> DataFrame:
    """All conversations as JSON records of the layouts of their shapes, and conversation -1, whose texts
    are control strings; a record without a mapping would be a row of nulls."""
    rows = read(spark, directory, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.format_conversations(chat.write_records(rows.unionByName(extra)), grouped=True).drop("unmapped", "n_records")


def op9_chunks(spark: SparkSession, directory: str) -> DataFrame:
    return chunks.document_fingerprints(read(spark, directory, "documents"))


def op10_mixing(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.selection(read(spark, directory, "documents"), WEIGHTS, SHARE)


def op11_minimax(spark: SparkSession, directory: str) -> DataFrame:
    return shards.shards(read(spark, directory, "documents"))


def op12_whitening(spark: SparkSession, directory: str) -> DataFrame:
    return whitening.whiten(read(spark, directory, "embeddings"))


def op13_manifest(spark: SparkSession, directory: str) -> DataFrame:
    return manifest.manifest(read(spark, directory, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_pii, op2_maxscore, op3_arrow_ids, op4_simhash, op5_fixity, op6_toxicity, op7_byte_bpe, op8_chat, op9_chunks, op10_mixing,
    op11_minimax, op12_whitening, op13_manifest)}
