"""The thin queries ``opN_<name>``: each applies its operator to a whole table
and derives the digest columns of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bytebpe, exactdedup, langid, linededup, materialise, neardedup, packing, pii, sharding
from .common import documents, text_size


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("record.text")
    return sharding.shard(documents(spark, sf_dir), 8).select(
        F.col("record.doc_id").alias("doc_id"),
        (text_size(text) + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


def op3_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).drop("row")


def surrogate_key(spark: SparkSession) -> str:
    """The session's key for surrogates; the invented documents of the tests need no secret one."""
    return spark.conf.get("spark.tracemill.surrogate.key", "for invented documents only")


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir), key=surrogate_key(spark)).select(
        F.col("record.doc_id").alias("doc_id"), "text", F.size("entities").cast("long").alias("n_entities"),
        F.transform("entities", lambda e: e["kind"]).alias("kinds"),
    )


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shards hold, read back from their files, with what was to be there."""
    path, index = materialise.materialise(documents(spark, sf_dir))
    return index.join(materialise.read_shards(spark, path, data=False), "slot")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip_digests(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, *langid.fit(docs)).select(
        "doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score"
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardedup.near_dedup(documents(spark, sf_dir)).drop("row")


def op9_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(documents(spark, sf_dir), min_chars=1).select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), "dropped",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_shards, op2_nearest, op3_packed, op4_surrogates, op5_training_order,
        op6_byte_bpe, op7_language, op8_near_duplicates, op9_exact_duplicates, op10_lines,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op9_exact_duplicates": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
