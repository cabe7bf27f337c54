"""Queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from . import bpe, exact_dedup, lexical, licences, line_dedup, media, mixing, quality, sentence_pieces, simhash, toxicity, vector_codes
from .common import documents


def op3_byte_bpe(spark, sf_dir):
    return bpe.encoding_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_token_counts(spark, sf_dir):
    return bpe.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op7_mix_sources(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).drop("source")


def op1_licence_scan(spark, sf_dir):
    return licences.licence_scan(documents(spark, sf_dir))


def op2_simhash(spark, sf_dir):
    return simhash.near_dedup(documents(spark, sf_dir))


def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(documents(spark, sf_dir)).select("doc_id", "text", "n_removed")


def op9_media_columns(spark, sf_dir):
    return media.media_columns(documents(spark, sf_dir)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op10_quality(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_lexical_search(spark, sf_dir):
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_sentence_pieces(spark, sf_dir):
    return sentence_pieces.encoding_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op13_vector_codes(spark, sf_dir):
    rows, books = vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_licence_scan, op2_simhash, op3_byte_bpe, op4_toxicity, op5_token_counts, op6_exact_dedup, op7_mix_sources, op8_line_dedup, op9_media_columns, op10_quality,
                                  op11_lexical_search, op12_sentence_pieces, op13_vector_codes)}
ORACLES = {"op6_exact_dedup": exact_dedup.ORACLE_SQL, "op8_line_dedup": line_dedup.ORACLE_SQL, "op11_lexical_search": lexical.ORACLE_SQL, "op13_vector_codes": vector_codes.ORACLE_SQL}
