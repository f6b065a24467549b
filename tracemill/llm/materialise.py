"""Training-order materialisation: fixed-stride binary shards of token ids.

Texts become token ids (word BPE, each text ended by id 0), joined within each
input partition and cut into sequences.  Numbering the sequences from 0 to N-1,
a keyed Feistel network permutes the numbers on the next even power of two;
walking its cycle until the value is below N gives every sequence its global
slot.  Rows go to shards by ranges of slots; each shard is one file of
little-endian uint16 ids in which sequence k starts at byte ``k * 2 * length``,
so a reader seeks to any slot and resumes there (``read_from``).  The file
``manifest.json`` beside the shards says how to read them.

Spark's own text writer makes the files (any file system, commit by rename):
the last id of every sequence is 0, whose last byte the writer sets as the line
separator, so nothing but the ids is in a file.

Defined results
    null and empty texts are the single id 0; documents run over sequence ends,
    in input order; the last sequence of a partition is padded with id 0 after
    ``used`` ids.  An empty input writes no shard.  Repeated rows are repeated;
    extra columns are not read.  Give a table or a checkpoint, whose partitions
    are the same when a lost task runs again.  An id that does not fit 16 bits
    is an error.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from glob import escape as glob_escape
from glob import glob

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, sized, written
from .tokens import word_ids

LENGTH = 1024
SHARD_SEQUENCES = 4096
ROUNDS = 6
CUT = "part int, nth long, used int, first_doc long, last_doc long, data binary"


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x ^ np.uint64(key)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed permutation of 0..n-1 at ``index``, by cycle walking."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = [int(k) for k in np.random.Generator(np.random.PCG64(key)).integers(0, 2**63, ROUNDS)]
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _cut(length: int, path: str | None):
    body = length - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_ids(path), TaskContext.get().partitionId()
        held, docs, nth = np.zeros(0, np.uint16), [], 0  # docs: (doc_id, ids left)

        def sequences(whole: bool):
            nonlocal held, docs, nth
            out = []
            while len(held) >= body or whole and len(held):
                take = held[:body]
                held, need = held[body:], len(take)
                used, first = need, docs[0][0]
                while True:
                    last, has = docs[0]
                    if has > need:
                        docs[0] = (last, has - need)
                        break
                    docs.pop(0)
                    need -= has
                    if not need:
                        break
                row = np.zeros(length, "<u2")
                row[:used] = take
                out.append((part, nth, used, first, last, row.tobytes()))
                nth += 1
            if out:
                cols = list(zip(*out, strict=True))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                    names=["part", "nth", "used", "first_doc", "last_doc", "data"],
                )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(at, 256).to_pylist()]
                new = [held]
                for doc, data in zip(batch.column(0).slice(at, 256).to_pylist(), words.batch(texts), strict=True):
                    ids = np.frombuffer(data, "<u4")
                    if len(ids) and ids.max() > 0xFFFF:
                        raise ValueError(f"id {ids.max()} does not fit the 16 bits of a shard's ids")
                    ids = ids.astype(np.uint16)
                    new += [ids, np.zeros(1, np.uint16)]
                    docs.append((doc, len(ids) + 1))
                held = np.concatenate(new)
                yield from sequences(False)
        yield from sequences(True)

    return run


def sequences(docs: DataFrame, *, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """Sequences of ``length`` ids, the last of them 0: part, nth, used, first_doc, last_doc, data."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(length, tokenizer), CUT)


def training_order(table: DataFrame, key: int) -> tuple[DataFrame, int]:
    """``table`` (written sequences) with ``sequence`` (0 to N-1) and ``slot``, and N."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row an input partition.
    starts = table.groupBy("part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    n = table.count()

    @F.pandas_udf("long")
    def slot(index):
        import pandas as pd

        return pd.Series(feistel(index.to_numpy(), n, key))

    return (
        table.join(sized(starts.select("part", "start"), "starts"), "part")
        .withColumn("sequence", F.col("start") + F.col("nth"))
        .withColumn("slot", slot("sequence"))
        .drop("start"),
        n,
    )


def materialise(
    docs: DataFrame, *, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, key: int = 2026,
    path: str | None = None, tokenizer: str | None = None,
) -> tuple[str, DataFrame]:
    """Write the shards; return their folder (``shard=k/`` each) and the index:
    sequence, slot, shard, used, first_doc, last_doc."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "shards")
    # Level 6 takes 7 % off token ids that level 3 leaves.
    cut = written(sequences(docs, length=length, tokenizer=tokenizer), "sequences", level=6)
    ordered, n = training_order(cut, key)
    shards = max(1, -(-n // shard_sequences))
    ordered = ordered.withColumn("shard", F.expr(f"cast(slot div {shard_sequences} as int)"))
    (
        # A shard is exactly one task's and one file.
        ordered.select("shard", "slot", F.expr(f"substring(data, 1, {2 * length - 1})").cast("string").alias("value"))
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", "slot")
        .select("shard", "value")
        .write.partitionBy("shard").option("lineSep", "\0").text(path)
    )
    manifest = {"sequences": n, "length": length, "shard_sequences": shard_sequences, "key": key, "dtype": "uint16", "order": "little", "permutation": f"feistel-{ROUNDS}"}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json")
    out = where.getFileSystem(conf).create(where, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    return path, ordered.select("sequence", "slot", "shard", "used", "first_doc", "last_doc")


def manifest_of(spark, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest.json").collect()))


def read_shards(spark, path: str, *, start: int = 0, data: bool = True) -> DataFrame:
    """Every sequence of the shards at ``path`` from slot ``start`` on: slot,
    ids_crc32 and, unless ``data`` is false, data.  Shards before it are not read."""
    manifest = manifest_of(spark, path)
    step, shard_sequences = 2 * manifest["length"], manifest["shard_sequences"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0), batch.column(1), strict=True):
                # One file at a time, not copied.
                view, first = memoryview(content.as_buffer()), shard.as_py() * shard_sequences
                skip = max(0, start - first)
                rows = [view[k : k + step] for k in range(skip * step, len(view), step)]
                out = {
                    "slot": pa.array(np.arange(len(rows), dtype=np.int64) + first + skip),
                    "ids_crc32": pa.array(map(zlib.crc32, rows), pa.int64()),
                }
                if data:
                    out["data"] = pa.array(map(bytes, rows), pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    schema = "slot long, ids_crc32 long" + ", data binary" * data
    if not manifest["sequences"]:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    shards = files.select(F.col("shard").cast("int").alias("shard"), "content").where(F.col("shard") >= start // shard_sequences)
    return shards.mapInArrow(run, schema)


def read_from(folder: str, slot: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) of each sequence from ``slot`` on, for a trainer that sees the
    folder as files: it seeks to the slot and reads on, one sequence in memory."""
    with open(f"{folder}/manifest.json", encoding="utf-8") as f:
        manifest = json.load(f)
    length, per = manifest["length"], manifest["shard_sequences"]
    while slot < manifest["sequences"]:
        (name,) = glob(f"{glob_escape(folder)}/shard={slot // per}/part-*")
        with open(name, "rb") as f:
            f.seek(slot % per * 2 * length)
            while row := f.read(2 * length):
                yield slot, np.frombuffer(row, "<u2")
                slot += 1
