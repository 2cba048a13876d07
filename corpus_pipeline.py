"""A corpus pipeline of five stages: language, quality, near duplicates, benchmark contamination, token ids.

Each stage takes all documents that the one before it kept, as a stored table. The first four drop documents and
return the columns of ``documents`` with their own values, whatever their names; the last gives the token ids.
Models are learnt from the stage's own input. In every stage a null text counts as an empty one, very long texts are
read whole, repeated rows are judged alike, and an empty table stays empty. Rows without an id take part in all but
the learning.
"""

from __future__ import annotations

import warnings

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldpulse.llm import bpe_codec, decontamination, language_id, ngram_jaccard, quality_crf
from worldpulse.llm.queries import BYTE_BPE, language_training, quality_field
from worldpulse.llm.shared import materialize, named, others, small_batches, table, unpack

OUTPUTS = ("n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter (so null and empty ones), those predicted as ``und``, and those that no learnt language
    codes in fewer bits than a uniform code: that measure doesn't fall with the number of similar languages."""
    small_batches(spark)
    found = language_id.found(docs, docs.columns, language_training(docs))
    known = (F.col("found.lang_pred") != language_id.UNKNOWN) & (F.col("found.bits_per_byte") < language_id.UNIFORM_BITS)
    return found.filter(known).select(*unpack(docs.columns))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts whose lines are bad for the most part. Where no text of either label is left to learn from, all stay."""
    small_batches(spark)
    field = quality_field(docs, table(spark, sf_dir, "labels"))
    if not field.known:
        warnings.warn("no quality field could be learnt: all documents stay", stacklevel=2)
        return docs
    return quality_crf.scored(docs, docs.columns, field).filter(F.col("score") >= quality_crf.THRESHOLD).select(*unpack(docs.columns))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies, the one of the smallest id. Texts without words are in no group and stay."""
    small_batches(spark)
    return ngram_jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that hold much of the benchmark: at least one word in twenty is inside a window of an item."""
    small_batches(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) with digests of the ids and of the text they decode to, beside the other columns."""
    small_batches(spark)
    coded = bpe_codec.round_trip(docs, public_tokenizers.path(BYTE_BPE), with_ids=True)
    return coded.select(*[named(c) for c in others(docs, "text", "n_chars", *OUTPUTS)], *OUTPUTS)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("near_duplicates", join_near_duplicates),
    ("decontamination", decontaminate),
    ("token_ids", encode),
]

#: Trained models, hashes of sets and merges can't be said in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
