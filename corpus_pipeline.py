"""A corpus pipeline of the training-data operators: recognise, deduplicate, cut repeats, mask secrets, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last keep the columns of documents.  When a stage begins, what the stages before it have stored
on the way is deleted, unless docs still reads it.

Null and empty texts: the language is unknown, so they go in the first stage.  Repeated rows: one is kept.  Very long texts
are read whole in each stage.  An empty table passes through all stages and makes no piece.  Other columns than text and
n_chars are kept as they are, whatever their names, until the last stage.
"""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm import language_id, near_copies, packing, secret_scan, suffix_dedup
from kairograph.llm.common import drop_scratch, scratch_of, stored, table

#: Documents of which less than this share of n-grams belongs to any one language are not taken for a language.
LEAST_SCORE = 0.3
#: Bytes of a passage that repeats; fifty words of most languages are longer.
REPEAT_BYTES = 250


def _stage(work):
    """Drops the scratch tables of the stages before; `owner` tells runs apart that are read side by side."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, owner: str = "stages") -> DataFrame:
        drop_scratch(spark, owner, docs)
        with scratch_of(owner):
            return work(spark, docs, sf_dir)

    return run_stage


@_stage
def recognise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the filters know; those without letters or unlike all languages go."""
    return language_id.keep_recognised(docs, language_id.learn(docs, ~language_id.held_out()), LEAST_SCORE)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: a Jaccard similarity of 0.8 or more of their five-word shingles."""
    return near_copies.keep_one(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as it is after the text has changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@_stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur more than once; a text that is nothing else goes."""
    return _counted(suffix_dedup.without_repeats(docs, REPEAT_BYTES))


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked."""
    return _counted(secret_scan.mask(docs))


@_stage
def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training windows."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", recognise), ("simhash_dedup", near_duplicates), ("suffix_dedup", repeats), ("secret_scan", secrets), ("packing", windows)]

#: SQL has no form for the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, owner = table(spark, sf_dir, "documents"), f"run-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        found = stage(spark, docs, sf_dir, owner)
        with scratch_of(f"{owner}-{k}"):
            docs = stored(found, name)
        if k:
            drop_scratch(spark, f"{owner}-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir, owner)
