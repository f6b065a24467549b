"""Fuzzy line deduplication.

Lines are split at newlines.  All but blank lines take part, trimmed and in lower
case; a caller may set ``min_chars``, below which lines always stay.  A line's features are its distinct shingles of ``SHINGLE_CHARS``
characters (one of the whole line, if it has fewer); their one-permutation
MinHash, each empty bin filled from the first other that has a value in an order
of its own, is banded for high recall, candidates are compared by exact Jaccard
similarity on all shingles, and of every component of the links one line stays:
the first in the input.

Defined results
    null text has no lines and stays null; empty text is one blank line.  Equal
    lines are in one component; repeated rows repeat their lines, of which the
    first stays.  An empty input gives no rows; extra
    columns are not read.  Give a table or a checkpoint, whose rows come in the
    same order when a lost task runs again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, ordinal, sized, written
from .graph import components
from .matching import candidate_links

SHINGLE_CHARS = 8
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
_KEYS = [f"b{k}" for k in range(BANDS)]
#: Cells of a line's sketch.
CELLS = 256
#: Characters whose shingles are made at a time (more in one line are one block).
BLOCK_CHARS = 1 << 16
#: Lines whose bins are made at a time: few enough for their arrays to stay in a core's cache.
BLOCK_LINES = 256
#: Bytes of the numbers of dropped lines that may be broadcast.
DROPPED_BYTES = 32 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def canonical(line: str) -> str:
    return line.strip().lower()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``lines`` (canonical), and the line of each."""
    # Newlines, which no line holds, make one shingle of a shorter line.
    lines = [line.ljust(SHINGLE_CHARS, "\n") for line in lines]
    text = "\n".join(lines)
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    width = 1
    base = _BASE
    while width < SHINGLE_CHARS:  # of twice as many characters each time
        here = x[: len(x) - width] * np.uint64(base)
        here += x[width:]
        x, base, width = here, base * base & _MASK, 2 * width
    lengths = np.array([len(line) for line in lines])
    # What begins at the last characters of a line, or between lines, is none.
    within = np.ones(len(x), bool)
    within[(np.cumsum(lengths[:-1] + 1)[:, None] - np.arange(1, SHINGLE_CHARS + 1)).ravel()] = False
    return _mix(x[within]), np.repeat(np.arange(len(lines)), lengths - SHINGLE_CHARS + 1)


@cache
def _order(size: int) -> np.ndarray:
    """For each of ``size`` bins all bins, in a seeded order."""
    return np.random.default_rng(size).permuted(np.tile(np.arange(size), (size, 1)), axis=1)


def bins(lines: list[str]) -> np.ndarray:
    """One-permutation MinHash (lines, BANDS * ROWS), uint64, without empty bins."""
    size = BANDS * ROWS
    hashes, owner = shingle_hashes(lines)
    empty = np.uint64(1 << 32)
    out = np.full(len(lines) * size, empty)
    cell = hashes >> np.uint64(32)
    cell *= np.uint64(size)
    cell >>= np.uint64(32)
    cell = cell.view(np.int64)
    cell += owner * size
    np.minimum.at(out, cell, hashes & np.uint64(0xFFFFFFFF))
    out = out.reshape(-1, size)
    # Each empty bin tries the others in its own order, so that in lines of few shingles, too, bins agree one by one.
    filled = out != empty
    i, j = np.nonzero(~filled)
    for tries in _order(size).T:
        if not len(i):
            break
        at = tries[j]
        found = filled[i, at]
        out[i[found], j[found]] = out[i[found], at[found]]
        i, j = i[~found], j[~found]
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(len(samples), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_BASE), rows.shape[:2])
    for j in range(ROWS):
        key = _mix(key + rows[:, :, j] * np.uint64(0xFF51AFD7ED558CCD))
    return key.view(np.int64)


class Matcher:
    """How two lines are compared."""

    similarity, cells = SIMILARITY, CELLS

    def features(self, text: str) -> tuple[np.ndarray, None]:
        return np.unique(shingle_hashes([canonical(text)])[0]), None

    def features_of(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, None]]:
        """``features`` of each text, in blocks of some characters."""
        block, chars = [], 0
        for text in texts:
            block.append(canonical(text))
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield from self._block(block)
                block, chars = [], 0
        if block:
            yield from self._block(block)

    def _block(self, lines: list[str]) -> Iterator[tuple[np.ndarray, None]]:
        hashes, owner = shingle_hashes(lines)
        ends = np.searchsorted(owner, np.arange(len(lines)), "right").tolist()
        for lo, hi in pairwise([0, *ends]):
            hashes[lo:hi].sort()
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[first], owner[first]
        for part in np.split(hashes, np.searchsorted(owner, np.arange(1, len(lines)))):
            yield part, None


def lines_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_row, line_no, row (the line's number in the input) and text of every line."""
    rows = docs.select(ordinal(docs).alias("doc_row"), F.col(text_col).alias("text"))
    return rows.select("doc_row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text")).withColumn(
        "row", F.monotonically_increasing_id()
    )


def signatures(lines: DataFrame, min_chars: int = 1) -> DataFrame:
    """doc_row, line_no, row, digest and band keys (b0, b1, ...) of the lines that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_LINES):
                part = batch.slice(at, BLOCK_LINES)
                texts = [canonical(t) for t in part.column(3).to_pylist()]
                some = [k for k, t in enumerate(texts) if len(t) >= max(1, min_chars)]
                if not some:
                    continue
                texts, part = [texts[k] for k in some], part.take(pa.array(some))
                digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
                keys = band_keys(bins(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(digests, pa.binary()), *map(pa.array, np.ascontiguousarray(keys.T))],
                    names=["doc_row", "line_no", "row", "digest", *_KEYS],
                )

    return lines.select("doc_row", "line_no", "row", "text").mapInArrow(
        run, "doc_row long, line_no int, row long, digest binary, " + ", ".join(f"{k} long" for k in _KEYS)
    )


def repeated_lines(docs: DataFrame, *, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """doc_row, line_no and row of every line that goes."""
    spark = docs.sparkSession
    lines = lines_of(docs, text_col)
    matcher = spark.sparkContext.broadcast(Matcher())
    table = written(signatures(lines, min_chars), "line_signatures", hashes=True)
    # Equal lines have equal band keys, so that any row's will do; buffers of longs keep this a hash aggregate.
    same = table.groupBy("digest").agg(F.min("row").alias("row"), F.count("*").alias("n"), *[F.min(k).alias(k) for k in _KEYS])
    same = written(same.select("digest", "n", "row", F.array(*_KEYS).alias("bands")), "distinct_lines", hashes=True)
    links = candidate_links(same.select("row", "bands"), lines.select("row", "text"), matcher)
    parts = sized(components(links.select("a", "b")).withColumnRenamed("node", "row"), "parts")
    # Only lines with a copy or a link are looked at further; the first of a component stays.
    hits = (
        same.select("digest", "n", "row").join(parts, "row", "left").where("n > 1 or label is not null")
        .select("digest", "row", F.coalesce("label", "row").alias("class"), F.col("label").isNotNull().alias("linked"))
    )
    hits = written(hits, "hits")
    tops = hits.groupBy("linked", "class").agg(F.min("row").alias("top"))
    decided = written(hits.join(tops, ["linked", "class"]).select("digest", "top"), "decided")
    rows = table.select("doc_row", "line_no", "row", "digest")
    if few(decided):
        found = rows.join(F.broadcast(decided), "digest")
    else:
        # A very common line is matched in the parts of the input that hold it.
        part = F.shiftright("row", 33).alias("part")
        local = rows.select(part, "digest").distinct().join(decided, "digest")
        found = rows.withColumn("part", part).join(local, ["part", "digest"])
    return found.where("row <> top").select("doc_row", "line_no", "row")


def line_dedup(docs: DataFrame, *, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """doc_id, text (of the lines that stay), n_lines and dropped (numbers of
    the lines that went) of each row of ``docs``."""
    gone = (
        repeated_lines(docs, text_col=text_col, min_chars=min_chars)
        .groupBy("doc_row").agg(F.sort_array(F.collect_list("line_no")).alias("dropped"))
    )
    # Bytes: 4 for each number, and what a row has besides.
    gone = sized(gone, "dropped_lines", DROPPED_BYTES, 4 * F.size("dropped") + 32)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), ordinal(docs).alias("doc_row"), F.col(text_col).alias("text"), F.split(text_col, "\n", -1).alias("lines")
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    return rows.join(gone, "doc_row", "left").select(
        "doc_id",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda k: F.get("lines", k)), "\n")).alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )
