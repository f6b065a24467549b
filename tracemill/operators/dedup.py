"""Deduplication of samples by the cosine of their embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


#: Samples of a problem up to which they are compared in one expression; larger groups in Arrow blocks.
SMALL_GROUP = 64


def _greedy(threshold: float, keys: list[str], order: str):
    """The greedy choice in one large group, a block of kept vectors at a time."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        x = np.array(table.column("_vec").to_pylist(), np.float64)
        kept = np.zeros(len(x), bool)
        far = np.ones(len(x), bool)
        for i in range(len(x)):
            if far[i]:
                kept[i] = True
                # Whatever follows and is too near goes at once.
                far[i + 1 :] &= ~(x[i + 1 :] @ x[i] > threshold)
        return table.select([*keys, order]).filter(pa.array(kept))

    return run


def greedy_dedup(rows: DataFrame, key: str | tuple[str, ...], order: str, vector: str, threshold: float = 0.92) -> DataFrame:
    """In each group, in order: the first stays, a later one if its cosine to all
    that stayed is at most ``threshold``.  Groups are the samples of one problem
    (of one file: key ``(file, problem)``), a few each; groups of one are passed on
    without a comparison."""
    keys = [key] if isinstance(key, str) else list(key)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    sized = rows.join(sizes, keys)
    one = F.struct(F.col(order).alias("ord"), F.col(vector).alias("vec"))
    groups = sized.where((F.col("_n") > 1) & (F.col("_n") <= SMALL_GROUP)).groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))

    def step(kept: Column, x: Column) -> Column:
        near = F.exists(kept, lambda k: dot(k["vec"], x["vec"]) > threshold)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(x)))

    small = groups.select(*keys, F.explode(F.transform(F.aggregate("all", none, step), lambda x: x["ord"])).alias(order))
    single = sized.where("_n = 1").select(*keys, order)
    large = sized.where(F.col("_n") > SMALL_GROUP).select(*keys, order, F.col(vector).alias("_vec"))
    large = large.groupBy(*keys).applyInArrow(_greedy(threshold, keys, order), single.schema)
    return single.union(small).union(large)


def positions(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``pos``, from 1 in the order of ``order``.

    Ranges of the order are numbered each for itself and moved by the sizes of those
    before: no task has all rows.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The cuts between the ranges, found once for both uses.
    cuts = rows.agg(F.percentile_approx(order, [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else []
    of = F.lit(0)
    for cut in sorted(set(cuts or [])):
        of = of + F.when(F.col(order) > cut, 1).otherwise(0)
    cut = rows.withColumn("_range", of)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range.
    starts = cut.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return cut.join(F.broadcast(starts), "_range").withColumn("pos", (at + F.col("_start")).cast("int")).drop("_range", "_start")


def positional_pairs(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """Row i of ``a`` with row i of ``b``; the tail of the longer alone."""
    left = positions(a, order).select("pos", F.struct(*a.columns).alias("a"))
    right = positions(b, order).select("pos", F.struct(*b.columns).alias("b"))
    return left.join(right, "pos", "full_outer")


def pairwise_dedup(a: DataFrame, b: DataFrame, order: str, vector: str, threshold: float = 0.92) -> DataFrame:
    """All of ``a``, and of ``b`` what is not nearer than ``threshold`` to its pair; interleaved by pos and side."""
    pairs = positional_pairs(a, b, order).withColumn("sim", dot(F.col(f"a.{vector}"), F.col(f"b.{vector}")))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("a").alias("rec"), F.col("a").isNotNull().alias("stays")),
        F.struct(F.lit(1).alias("side"), F.col("b").alias("rec"), (F.col("b").isNotNull() & (F.col("a").isNull() | (F.col("sim") <= threshold))).alias("stays")),
    )
    return pairs.select("pos", F.explode(sides).alias("s")).where("s.stays").select("pos", "s.side", F.col(f"s.rec.{order}").alias(order))


def group_pairs(rows: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """Cosines of the pairs within each group of samples (i before j)."""
    i = rows.select(key, F.col(order).alias("i"), F.col(vector).alias("vi"))
    j = rows.select(key, F.col(order).alias("j"), F.col(vector).alias("vj"))
    return i.join(j, key).where("i < j").select(key, "i", "j", dot(F.col("vi"), F.col("vj")).alias("sim"))


def redundancy(rows: DataFrame, key: str, order: str, vector: str, threshold: float = 0.92) -> DataFrame:
    """Mean cosine, share of pairs and share of groups at or over the threshold."""
    per = group_pairs(rows, key, order, vector).groupBy(key).agg(
        F.count("*").alias("n"), F.sum("sim").alias("s"), F.count_if(F.col("sim") >= threshold).alias("over")
    )
    return per.agg(
        F.count("*").alias("groups"), F.sum("n").alias("pairs"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean_sim"),
        F.round(F.sum("over") / F.sum("n") * 100, 6).alias("pairs_over_pct"),
        F.round(F.count_if(F.expr("over = n")) / F.count("*") * 100, 6).alias("groups_over_pct"),
    )


def dedup_stats(rows: DataFrame, kept: DataFrame, *keys: str, by: str | None = None) -> DataFrame:
    """Accounting of :func:`greedy_dedup`: samples, and problems by their samples before.

    A pair is a sample that was compared with those kept before it; above the
    threshold it went.  ``by`` (one of the keys, a file) gives a row for each
    file and one, of null, for all.
    """
    before = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    after = kept.groupBy(*keys).agg(F.count("*").alias("left"))
    per = before.join(after, list(keys), "left").withColumn("left", F.coalesce("left", F.lit(0)))
    total = per.rollup(by) if by else per.groupBy()
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    return total.agg(
        F.count("*").alias("problems"), F.sum("n").alias("before"), F.sum("left").alias("after"), (F.sum("n") - F.sum("left")).alias("discarded"),
        F.round(F.sum("left") / F.sum("n") * 100, 6).alias("retention"), n("n = 1", "one"), n("n = 2", "two"), n("n >= 3", "more"),
        F.sum(F.col("n") - 1).alias("pairs_total"), (F.sum("n") - F.sum("left")).alias("pairs_above"),
    )


Encoder = Callable[[list[str]], np.ndarray]


def embed(rows: DataFrame, encoder: Encoder, text: str, name: str = "embedding", batch: int = 64) -> DataFrame:
    """``rows`` with unit vectors of ``text``.

    ``encoder`` takes a list of at most ``batch`` texts and gives a matrix of their
    vectors; a null text counts as empty, a vector of norm zero stays as it is.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for start in range(0, some.num_rows, batch):
                part = some.slice(start, batch)
                x = np.asarray(encoder([t or "" for t in part.column(at).to_pylist()]), np.float64)
                norms = np.linalg.norm(x, axis=1, keepdims=True)
                unit = x / np.where(norms == 0, 1, norms)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(unit), pa.list_(pa.float64()))], names=[*part.schema.names, name])

    return rows.mapInArrow(run, schema)
