"""Best-fit packing planned on the length histogram.

Documents become token ids followed by id 0 and are cut into pieces of at most
``capacity`` ids; only longer ones are cut.  The counts of pieces by length (at
most ``capacity`` numbers, whatever the input) are planned on the driver by
best-fit decreasing; pieces then take the planned places by their rank within
their length.

Defined results
    a null or empty text is the single id 0; repeated rows and ids are packed
    each for itself; an empty input gives no rows.  Pieces of equal length are
    ranked by (doc_id, piece, row), so ties are settled alike in every run.
    Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ordinal, written
from .tokens import word_ids

CAPACITY = 2048
#: Ranks within a length are counted in lanes, so that no task gets a whole length.
LANE_ROWS = 50_000
PIECES = "doc_id long, row long, piece int, start long, length int, ids_crc32 long"


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows (length, rank, count, sequence, each, offset): the ``count`` pieces of
    ``length`` from ``rank`` on go to sequences from ``sequence`` on, ``each``
    pieces to one, the first at ``offset`` in it.  Sequences that hold as much
    stay together as ranges, so the work depends on lengths, not on pieces.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first, how many)]
    plan, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} ids cannot be packed")
        for room in sorted(r for r in free if r >= length):
            each = room // length
            ranges = free.pop(room)
            while ranges and left:
                first, n = ranges.pop()
                full = min(n, left // each)
                if full:
                    plan.append((length, rank, full * each, first, each, capacity - room))
                    free[room - each * length].append((first, full))
                    rank, left = rank + full * each, left - full * each
                if full < n and 0 < left < each:
                    plan.append((length, rank, left, first + full, left, capacity - room))
                    free[room - left * length].append((first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < n:
                    ranges.append((first + full, n - full))
                    if left >= each:
                        continue
                    break
            if ranges:
                free[room] = ranges + free[room] if room in free else ranges
            if not left:
                break
        each = capacity // length
        if full := left // each:
            plan.append((length, rank, full * each, opened, each, 0))
            free[capacity - each * length].append((opened, full))
            opened, rank, left = opened + full, rank + full * each, left - full * each
        if left:
            plan.append((length, rank, left, opened, left, 0))
            free[capacity - left * length].append((opened, 1))
            opened += 1
        free.pop(0, None)
    return plan


def _tokenize(capacity: int, path: str | None):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            ids, rows, texts = batch.column(0), batch.column(1), batch.column(2)
            for at in range(0, batch.num_rows, 256):
                some = [t or "" for t in texts.slice(at, 256).to_pylist()]
                out = []
                docs = zip(ids.slice(at, 256).to_pylist(), rows.slice(at, 256).to_pylist(), words.batch(some), strict=True)
                for doc, row, data in docs:
                    data += b"\0\0\0\0"
                    for k, start in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[start : start + 4 * capacity]
                        out.append((doc, row, k, start // 4, len(part) // 4, zlib.crc32(part)))
                doc, row, piece, start, length, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())],
                    names=["doc_id", "row", "piece", "start", "length", "ids_crc32"],
                )

    return pieces


def pieces(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pieces of the ids of each text: doc_id, row, piece, start, length, ids_crc32."""
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        ordinal(docs).alias("row"),
        F.col("text").alias("text"),
    )
    return read.mapInArrow(_tokenize(capacity, tokenizer), PIECES)


def place(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Planned places for ``table`` (written; columns as of :func:`pieces`).

    Adds sequence_id and offset.  ``table`` is read twice: for the histogram by
    lane, and for the ranks.
    """
    spark = table.sparkSession
    lanes = max(1, -(-table.count() // LANE_ROWS))
    laned = table.withColumn("lane", F.pmod(F.xxhash64("doc_id", "row"), F.lit(lanes)))
    counts = laned.groupBy("length", "lane").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lane_starts = counts.select("length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lane_start"))
    # At most ``capacity`` rows reach the driver.
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    plan = plan_best_fit(histogram, capacity)
    steps: dict[int, list] = defaultdict(list)
    for length, *step in plan:
        steps[length].append(tuple(step))
    schema = "length int, steps array<struct<rank long, n long, seq long, each long, off long>>"
    # The plan grows with lengths, not with the input: at most ``capacity`` rows.
    planned = spark.createDataFrame(sorted((k, sorted(v)) for k, v in steps.items()), schema)
    in_lane = Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "row")
    ranked = (
        laned.withColumn("in_lane", F.row_number().over(in_lane) - 1)
        .join(lane_starts, ["length", "lane"])
        .withColumn("rank", F.col("lane_start") + F.col("in_lane"))
    )
    step = F.element_at(F.filter("steps", lambda s: s["rank"] <= F.col("rank")), -1)
    return (
        ranked.join(F.broadcast(planned), "length")
        .withColumn("step", step)
        .withColumn("nth", F.col("rank") - F.col("step.rank"))
        .select(
            "doc_id", "row", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
            F.expr("step.seq + nth div step.each").alias("sequence_id"),
            F.expr("step.off + nth % step.each * length").cast("long").alias("offset"),
        )
    )


def pack(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with the sequence and the offset that each takes."""
    return place(written(pieces(docs, capacity=capacity, tokenizer=tokenizer), "pieces"), capacity)
