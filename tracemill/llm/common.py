"""What the operators share: the shared folder, written tables and small helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all of it runs in one process (tests) is a temporary one set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths made within each open ``scratch`` block.
_made: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tracemill/{name}-{uuid.uuid4().hex}"
    for paths in _made[-1:]:
        paths.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what operators wrote to scratch paths within the block;
    results have to be written elsewhere before."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            _delete(spark, path)


def ordinal(docs: DataFrame) -> Column:
    """A number for each row of ``docs``, part of the input << 33 and place in it.

    Spark cuts small inputs by the cores it has; that number is held for the
    session, so that a scan after the loss of an executor counts alike.
    """
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.files.minPartitionNum", None) is None:
        conf.set("spark.sql.files.minPartitionNum", docs.sparkSession.sparkContext.defaultParallelism)
    return F.monotonically_increasing_id()


def written(df: DataFrame, name: str, path: str | None = None, *, level: int = 3, hashes: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder (zstd at ``level``) and read it back.

    This cuts lineage at a commit point that survives the loss of any executor;
    every task attempt either commits its whole file or none.  Columns that are
    mostly ``hashes`` are written as they are, as nothing makes them smaller.
    """
    path = path or scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level)
    if hashes:
        writer = df.write.option("compression", "snappy").option("parquet.enable.dictionary", "false")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows, about, that a Python worker is sent at once.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_BYTES`` for Python workers, held for the session, unless it names a bound.

    Spark's own is 64 MB: each task holds as much, and more while it grows, on
    either side of the pipe, and what one stage took stays with the executor's
    processes for those after it.  A longer row is a batch of its own.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: Rows of a few numbers each that may be broadcast.
BROADCAST_ROWS = 500_000


def few(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return table.limit(rows + 1).count() <= rows


def sized(df: DataFrame, name: str, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """``df`` written, with the hint to broadcast it if it has few rows; beyond
    that the join is left to Spark.  Rows of no fixed size count ``weight`` each."""
    table = written(df, name)
    small = few(table, rows) if weight is None else (table.agg(F.sum(weight)).first()[0] or 0) <= rows
    return F.broadcast(table) if small else table


#: Rows of the input that one bitmap tells about, and bitmaps (4 kB each) that may be broadcast.
BITMAP_BITS = 1 << 15
BITMAPS = 1 << 14


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ordinals ``gone`` (row) lists.

    What goes is a bitmap for each run of 32,768 ordinals.  Up to ``BITMAPS`` of
    them are broadcast, so that no text is shuffled; beyond that rows meet their
    numbers by a join.
    """
    row = unique_name(docs, "row")
    numbered = docs.withColumn(row, ordinal(docs))
    gone = written(gone.select("row"), "gone")
    at = F.shiftright("row", 15)
    bits = gone.groupBy(at.alias("run")).agg(F.bitmap_construct_agg(F.col("row").bitwiseAND(BITMAP_BITS - 1)).alias("bits"))
    bits = written(bits, "bitmaps")
    if not few(bits, BITMAPS):
        return numbered.join(gone.select(F.col("row").alias(row)), row, "left_anti").drop(row)
    run, held, place = unique_name(docs, "run"), unique_name(docs, "bits"), F.col(row).bitwiseAND(BITMAP_BITS - 1)
    byte = F.conv(F.hex(F.substring(held, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    bit = F.floor(byte / F.pow(F.lit(2), place.bitwiseAND(7))) % 2
    return (
        numbered.withColumn(run, F.shiftright(row, 15))
        .join(F.broadcast(bits.select(F.col("run").alias(run), F.col("bits").alias(held))), run, "left")
        .where(F.col(held).isNull() | (bit == 0))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def unique_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_size(text) -> F.Column:
    """UTF-8 bytes; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
