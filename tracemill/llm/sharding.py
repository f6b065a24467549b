"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly, by a seeded hash of their id and text, into
buckets that fit a worker's memory.  Pass two puts each bucket into a canonical
order, shuffles it by Fisher-Yates with a generator seeded by (seed, bucket) and
writes it; Python draws the places from a bucket's number of rows alone, so that
no record passes through a Python worker.  Bucket after bucket, the written rows
are one random permutation of the input; contiguous runs of it are the shards, so
that their row counts differ by one at most (law ``rows``).  The number of buckets
depends on the bytes of the input alone: the same rows come out alike from any
files and on any cluster.

Defined results
    null and empty texts are records like any other, null ids too; repeated rows
    are kept.  Rows equal in id and text of which there are more than
    ``REPEATS`` are scattered by their place in the input instead, so that no
    bucket takes them all; which of them goes where then depends on the input's
    layout.  An empty input gives no rows; input columns travel inside the struct
    ``record``, so that no name can clash with those added here.  Give a table or
    a checkpoint, whose rows come in the same order when a lost task runs again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ordinal, sized, text_size, written

#: Rows equal in id and text that may go to one bucket.
REPEATS = 1_000


def _fisher_yates(seed: int):
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, rows in zip(*(batch.column(c).to_pylist() for c in ("bucket", "rows")), strict=True):
                order = np.arange(rows, dtype=np.uint64)
                np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
                place = np.empty(rows, np.int32)
                place[order] = np.arange(rows, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int64()), pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), pa.array(place))],
                    names=["bucket", "places"],
                )

    return places


def external_shuffle(
    docs: DataFrame,
    *,
    seed: int = 20_26,
    bucket_bytes: int = 16 << 20,
    text_col: str = "text",
    id_col: str = "doc_id",
    path: str | None = None,
) -> tuple[DataFrame, int]:
    """Write ``docs`` in random order; return the table and its number of rows.

    Columns: bucket, pos (place in the bucket), record (all input columns).
    ``bucket_bytes`` bounds the text of a bucket in expectation; buckets grow in
    number with the input, never in size.
    """
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), ordinal(docs).alias("ord")
    ).withColumn("key", F.xxhash64(F.lit(seed), F.col("record")[id_col], F.col("record")[text_col]))
    n, total = base.agg(F.count("*"), F.sum(text_size(F.col("record")[text_col]) + 64)).first()
    buckets = max(math.ceil((total or 0) / bucket_bytes), 1)
    # At most one in REPEATS rows; a broadcast only if these are few.
    repeated = base.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > REPEATS).select("key", F.lit(True).alias("repeated"))
    place = F.when(F.col("repeated"), F.xxhash64(F.lit(seed), "ord")).otherwise(F.xxhash64(F.lit(seed), "key"))
    scattered = base.join(sized(repeated, "repeated"), "key", "left").select(F.pmod(place, F.lit(buckets)).alias("bucket"), "key", "ord", "record")
    # A place for each row of a bucket, in canonical order.  Spark takes these arrays for small, so the join says not to broadcast them.
    places = scattered.groupBy("bucket").agg(F.count("*").alias("rows")).mapInArrow(_fisher_yates(seed), "bucket long, places array<int>")
    canonical = Window.partitionBy("bucket").orderBy("key", "ord")
    shuffled = (
        scattered.withColumn("rank", F.row_number().over(canonical) - 1)
        .join(places.hint("merge"), "bucket")
        .select("bucket", F.col("places")[F.col("rank")].cast("long").alias("pos"), "record")
        .sortWithinPartitions("bucket", "pos")
    )
    return written(shuffled, "shuffled", path), n


def shard(docs: DataFrame, shards: int = 8, **options) -> DataFrame:
    """Rows of ``docs`` in shards 0..shards-1 of near equal row counts.

    Columns: shard, slot (gapless from 0 within the shard), record.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    table, n = external_shuffle(docs, **options)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row a bucket: as many as the input has bytes over bucket_bytes.
    starts = (
        table.groupBy("bucket").agg(F.count("*").alias("rows"))
        .select("bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    )
    small, extra = divmod(n, shards)
    place = F.col("start") + F.col("pos")
    large_rows = extra * (small + 1)
    in_large = place < large_rows
    one = max(small, 1)
    return (
        table.join(sized(starts, "starts"), "bucket")
        .withColumn("place", place)
        .select(
            F.when(in_large, F.expr(f"place div {small + 1}"))
            .otherwise(extra + F.expr(f"(place - {large_rows}) div {one}"))
            .cast("int").alias("shard"),
            F.when(in_large, F.expr(f"place % {small + 1}"))
            .otherwise(F.expr(f"(place - {large_rows}) % {one}"))
            .cast("long").alias("slot"),
            "record",
        )
    )
