"""Union, shuffle, split and formatting of training rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(*frames: DataFrame) -> DataFrame:
    """All rows; fields that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shuffle_key(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def shuffle(rows: DataFrame, key: str, seed: int = 42, enabled: bool = True) -> DataFrame:
    """A seeded order by the hash of a unique key: a range sort, the same in any engine; the rows as they are if not ``enabled``."""
    return rows.orderBy(shuffle_key(key, seed), key) if enabled else rows


def prefix(rows: DataFrame, order: str, most: int = 0) -> DataFrame:
    """The first ``most`` rows in order; all for 0."""
    return rows.orderBy(order).limit(most) if most else rows


def split(rows: DataFrame, key: str, train_share: float = 0.9, seed: int = 42, tie: str | None = None) -> DataFrame:
    """``part``: train for the first floor(n * share) of the shuffled order, else test.

    The cut is a quantile of the hash, found by sizes of hash ranges: no row is
    numbered in a single task.  ``tie`` orders rows of one key.
    """
    hashed = rows.withColumn("_h", shuffle_key(key, seed)).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))  # 4096 rows at most
    starts = sizes.select(
        "_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"),
        F.floor(F.sum("_n").over(Window.partitionBy()) * F.lit(train_share)).alias("_cut"),
    )
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key, *([tie] if tie else []))) + F.col("_s")
    return (
        hashed.join(F.broadcast(starts), "_b")
        .withColumn("part", F.when(rank <= F.col("_cut"), "train").otherwise("test"))
        .drop("_h", "_b", "_s", "_cut")
    )


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt(problem: Column, system: str | None = None) -> Column:
    """Messages that ask for a problem; without a system text the problem alone."""
    if system is None:
        return F.array(_message("user", problem))
    return F.array(_message("system", F.lit(system)), _message("user", F.concat(F.lit("Problem: "), problem)))


def sft_messages(problem: Column, answer: Column, system: str) -> Column:
    return F.concat(prompt(problem, system), F.array(_message("assistant", answer)))
