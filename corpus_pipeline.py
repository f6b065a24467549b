"""From documents to packed training sequences.

Each stage takes what the one before kept, whole; its result is written to the
shared folder and read again as the next one's ``docs``.  Duplicates go by
bitmaps over the rows of the input (``common.without``), so that no text is
shuffled to drop a row.

Defined results
    null text, and text without a letter, goes at ``language``; empty input
    passes every stage and gives no rows.  Of texts equal or near to each other
    one stays; repeated rows, with one id, count as copies.  Extra columns stay
    as they are until ``packed``, which returns pieces; names used inside a
    stage do not clash with them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import exactdedup, langid, neardedup, packing, pii
from tracemill.llm.common import bound_batches, documents, scratch, scratch_path, without, written
from tracemill.llm.queries import surrogate_key


def small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``stage`` with small batches for Python workers (``bound_batches``)."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predict every document's language; those in which none is found go."""
    labels, prototypes = langid.fit(docs)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), "text")
    found = langid.predict(whole, labels, prototypes, keep=("record",)).where(F.col("lang_pred") != langid.UND)
    return found.select(*[F.col("lang_pred" if c == "lang" else f"record.`{c}`").alias(c) for c in docs.columns])


@small_batches
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return without(docs, exactdedup.exact_dedup(docs).where("not kept"))


@small_batches
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents the smallest doc_id stays."""
    return without(docs, neardedup.near_dedup(docs).where("not kept"))


@small_batches
def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    made = pii.pseudonymise(docs, key=surrogate_key(spark))
    return made.select(*[new.get(c, F.col(f"record.`{c}`")).alias(c) for c in docs.columns])


@small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048."""
    return packing.pack(docs).drop("row")


STAGES = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("private", private),
    ("packed", packed),
]

#: None of the stages but ``exact`` can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage_{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
    return docs
