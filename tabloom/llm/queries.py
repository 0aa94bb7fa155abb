"""The registered queries of this package and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    edit_embedding,
    hadamard_clusters,
    languages,
    mixing,
    personal_data,
    perspectives,
    posting_lists,
    projection_passes,
    sentencepiece_backend,
    simhash,
    suffix_arrays,
    toxicity,
    whitening,
)
from .common import Query, table


def op1_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.neighbour_documents(table(spark, sf_dir, "embeddings"))


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_documents(spark, table(spark, sf_dir, "documents"))


def op3_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.edited_documents(table(spark, sf_dir, "documents"))


def op5_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_backend.encode_decode(table(spark, sf_dir, "documents"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_documents(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.private_documents(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op10_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.remove_repeats(table(spark, sf_dir, "documents"))


def op11_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_vectors(table(spark, sf_dir, "embeddings"))


def op12_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_passes.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_hadamard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hadamard_clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_posting_lists": op1_posting_lists,
    "op2_simhash_pivots": op2_simhash_pivots,
    "op3_toxicity_nnpu": op3_toxicity_nnpu,
    "op4_edit_embedding": op4_edit_embedding,
    "op5_perspective_rotation": op5_perspective_rotation,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_language_mixture": op7_language_mixture,
    "op8_personal_data": op8_personal_data,
    "op9_mix_sources": op9_mix_sources,
    "op10_suffix_arrays": op10_suffix_arrays,
    "op11_exact_whitening": op11_exact_whitening,
    "op12_projection_passes": op12_projection_passes,
    "op13_hadamard_clusters": op13_hadamard_clusters,
}
ORACLE: dict[str, str] = {
    "op5_perspective_rotation": perspectives.OP5_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op13_hadamard_clusters": hadamard_clusters.OP13_SQL,
}
