"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition makes a run for each lane of the digest space: its
distinct digests in order, each with the identifier that stays so far and the
number of rows.  In each round the runs of one lane that differ only in the low
bits of their number meet in one task, where the sorted runs, checked to be in
order, are merged; an entry's digest and byte length are compared in full and
the identifier is chosen anew at every level.
After log(partitions) rounds each lane is one run.  A group of copies is one
entry in a run however large it is, so it weighs as much as any other.

Decisions go back by (partition, digest): a group's rows are matched in the
partitions that hold them, never in one task.

Defined results
    null text counts as empty; texts are equal when their SHA-256 and byte
    length are; of equal texts the row with the largest id stays (``keep`` =
    "largest", or "smallest").  Repeated rows with one id form one group; only
    one of them is kept.  A null id is kept only in a group without other ids.
    An empty input gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ordinal, text_size, written

#: Runs that meet in one task in a round.
FAN_IN = 8
#: Input rows for each lane; bounds a lane's last run.
LANE_ROWS = 250_000
RUN = "lane int, run int, keys binary, ids binary, rows binary, known binary, counts binary"


def digests(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, row, part (of the input), digest (binary SHA-256) and size of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        ordinal(docs).alias("row"),
        F.spark_partition_id().alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text_size(text).alias("size"),
    )


Run = dict[str, np.ndarray]


def _table(lane, run, data: Run) -> pa.Table:
    blobs = {k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in data.items()}
    return pa.table({"lane": pa.array([lane], pa.int32()), "run": pa.array([run], pa.int32()), **blobs})


def _better(ids, rows, known, other_ids, other_rows, other_known) -> np.ndarray:
    """Where the second identifier stays: the one there is, then the larger, then of the earlier row."""
    larger = (other_ids > ids) | (other_ids == ids) & (other_rows < rows)
    return (other_known > known) | (other_known == known) & np.where(known > 0, larger, other_rows < rows)


def sorted_run(keys, ids, rows, known) -> Run:
    """A run of the rows of one partition: each key once, in order."""
    order = np.lexsort((rows, ~ids, -known.astype(np.int8), keys))
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(at, len(keys)))
    return {"keys": keys[at], "ids": ids[order][at], "rows": rows[order][at], "known": known[order][at], "counts": counts}


def merge_two(a: Run, b: Run) -> Run:
    """Two sorted runs as one: equal keys, compared in full, keep one identifier."""
    for run in (a, b):
        if (run["keys"][1:] <= run["keys"][:-1]).any():
            raise ValueError("a run is not in order")
    at = np.searchsorted(a["keys"], b["keys"])
    met = np.zeros(len(at), bool)
    inside = at < len(a["keys"])
    met[inside] = a["keys"][at[inside]] == b["keys"][inside]
    i, out = at[met], {k: v.copy() for k, v in a.items()}
    out["counts"][i] += b["counts"][met]
    wins = _better(*(a[k][i] for k in ("ids", "rows", "known")), *(b[k][met] for k in ("ids", "rows", "known")))
    for k in ("ids", "rows", "known"):
        out[k][i[wins]] = b[k][met][wins]
    return {k: np.insert(v, at[~met], b[k][~met]) for k, v in out.items()}


def merged(runs: list[Run]) -> Run:
    """Sorted runs as one, merged two by two."""
    while len(runs) > 1:
        runs = [merge_two(*runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
    return runs[0]


_KINDS = {"keys": "S40", "ids": np.int64, "rows": np.int64, "known": np.uint8, "counts": np.int64}


def _first_runs(sign: int):
    def make(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        known = np.array(table.column("doc_id").is_valid().to_numpy(), np.uint8)
        ids = table.column("doc_id").fill_null(0).to_numpy()
        sizes = table.column("size").to_numpy().astype(">i8").view("V8")
        keys = np.frombuffer(b"".join(d + s.tobytes() for d, s in zip(table.column("digest").to_pylist(), sizes, strict=True)), "S40")
        return _table(key[0].as_py(), key[1].as_py(), sorted_run(keys, ids if sign > 0 else ~ids, table.column("row").to_numpy(), known))

    return make


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    runs = [{k: np.frombuffer(run[k], kind) for k, kind in _KINDS.items()} for run in table.select(list(_KINDS)).to_pylist()]
    return _table(key[0].as_py(), key[1].as_py(), merged(runs))


def _unpack(sign: int):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.to_pylist():
                ids, known = np.frombuffer(run["ids"], np.int64), np.frombuffer(run["known"], np.uint8) > 0
                keys = [run["keys"][k : k + 40] for k in range(0, len(run["keys"]), 40)]
                number = lambda name: pa.array(np.frombuffer(run[name], np.int64))  # noqa: B023, E731
                size = pa.array(np.frombuffer(b"".join(k[32:] for k in keys), ">i8").astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[:32] for k in keys], pa.binary()), size, pa.array(ids if sign > 0 else ~ids, mask=~known), number("rows"), number("counts")],
                    names=["digest", "size", "keep_id", "keep_row", "group_size"],
                )

    return entries


def merge_tree(table: DataFrame, parts: int, rows: int, keep: str = "largest") -> DataFrame:
    """One entry for each distinct (digest, size) of ``table``: keep_id, group_size."""
    sign = {"largest": 1, "smallest": -1}[keep]
    lanes = max(1, math.ceil(rows / LANE_ROWS))
    lane = F.pmod(F.xxhash64("digest"), F.lit(lanes)).cast("int").alias("lane")
    runs = (
        table.select(lane, F.col("part").alias("run"), "digest", "size", "doc_id", "row")
        .groupBy("lane", "run").applyInArrow(_first_runs(sign), RUN)
    )
    left = parts
    while left > 1:
        runs = (
            runs.withColumn("run", F.expr(f"run div {FAN_IN}").cast("int"))
            .groupBy("lane", "run").applyInArrow(_merge, RUN)
        )
        left = -(-left // FAN_IN)
    return runs.select("keys", "ids", "rows", "known", "counts").mapInArrow(
        _unpack(sign), "digest binary, size long, keep_id long, keep_row long, group_size long"
    )


def exact_dedup(docs: DataFrame, *, keep: str = "largest", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, row, digest, keep_id, group_size, kept."""
    table = written(digests(docs, text_col), "digests")
    rows, parts = table.agg(F.count("*"), F.max("part")).first()
    final = merge_tree(table, (parts or 0) + 1, rows, keep)
    # Each partition's distinct digests take the decision; then its rows do.
    local = table.select("part", "digest", "size").distinct().join(final, ["digest", "size"])
    return table.join(local, ["part", "digest", "size"]).select(
        "doc_id", "row", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept")
    )
