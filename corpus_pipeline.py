"""The corpus pipeline: five stages, each over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmill.llm import bpe, line_dedup, mixing, quality, simhash
from linkmill.llm.common import materialise

#: None: the first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None
#: Chunks that a worker of the last stage remembers: the other stages' tasks share its executor's memory.
REMEMBER = 150_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null text is scored as the empty one, very long texts are read whole, repeated rows fare alike, a null doc_id
    makes no difference. Empty table: no rows. Columns of any name pass through.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated lines, runs of lines and passages go, as line_dedup has it for every case; n_chars follows the text."""
    out = line_dedup.line_dedup(docs).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, as simhash.keep_one has it for every case; rows that repeat a doc_id, or have none, are copies like others."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row stands once for every epoch of it that the mix takes, as mixing.repeated has it for every case."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of the mix, as encoding_digests has it for every case."""
    return bpe.encoding_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, remember=REMEMBER)


STAGES = [("quality classifier", quality_classifier), ("line dedup", lines), ("SimHash near-dedup", near_dedup), ("mixing sources to target weights", mix), ("byte-level BPE encoding and decoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = materialise(docs, f"stage-{n}")
    return docs
