"""A training corpus in five stages: toxic documents go, one of each group of near copies stays, personal
data is masked, sources are mixed to their weights, and what is left is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import mixing, near_copies, personal_data, sentencepiece_backend, toxicity
from tabloom.llm.common import c, small_batches, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7; the classifier is fitted on this stage's documents.

    NULL texts are scored as empty ones; equal texts, repeated rows too, have equal scores. All columns stay.
    """
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).filter("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more).

    The smallest id stays, a NULL id last; NULL, empty and blank texts are copies of each other.
    """
    return near_copies.drop_near_copies(docs)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in every text; n_chars is the new length.

    NULL texts stay NULL, as does their n_chars; every row stays, repeated ones too.
    """
    masked = personal_data.mask_documents(docs, personal_data.fit_tagger(docs))
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.select(*[
        F.length(c("text")).cast(kind).alias(n) if n == "n_chars" else c(n) for n in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their target weights."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, repeated ones too, with parity and round trip; NULL and empty texts have no tokens."""
    return sentencepiece_backend.encode_decode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_copies),
    ("personal_data", mask_personal),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

# The classifier, the tagger and the tokenizer cannot be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
