"""Nearest neighbours by additive quantisation.

Codebooks of full dimension are fitted level by level to the residuals of a
bounded sample.  Every vector is encoded by a beam search over the levels and
kept as one byte a level with the norm of its reconstruction.  A query makes a
table of its products with all codewords; a vector's score is the sum of its
entries over the stored norm.  The best ``rerank`` of each task are compared
again by the exact cosine on the original vectors, which lie beside the codes, and
only the ``k`` best of these leave the task.

With each code its error is kept: the angle between the vector and its
reconstruction.  The angle of a query to a vector is at least that to the
reconstruction less the error, so a second scan passes over what cannot reach
the query's ``k``-th exact cosine and compares all else, uncapped: the ``k``
found are the nearest, however many vectors lie closer than the codes can tell.

Queries are a stated set, compared with all codes: in blocks of bounded size,
each sent to the tasks that scan the codes.  There are a few such tasks for each
core, whatever the input, so that what is shuffled grows with the queries only.

Defined results
    vectors that are null, of norm zero, or hold null or non-finite components
    take no part, nor do those of another dimension than most of the sample.
    Fewer candidates than ``k`` are all returned.  Equal codes go by the smaller
    id, equal cosines too.  Ids must not repeat: rows that repeat one count as
    one, with the least vector in array order.  Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEVELS, WORDS, BEAM = 16, 256, 4
#: Rows that the codebooks are fitted to, at most.
SAMPLE_ROWS = 16_384
#: Candidates a query and task that go to the exact comparison.
RERANK = 32
#: Tasks of a scan for each core.
TASKS_A_CORE = 4
#: Queries in one block; their vectors are what is broadcast.
QUERY_BLOCK = 2_048
SCAN_ROWS = 2_048
#: Pairs of a query and a vector that the second scan looks at together.
PAIRS = 1 << 20
#: What rounding in single precision can do to a guess, at most.
ROUNDING = 1e-5


class Codebooks:
    """Additive codebooks (levels, words, dimension) with beam-search encoding."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __reduce__(self):
        # What is sent are the words; their products, far larger, are made where vectors are encoded.
        return Codebooks, (self.words,)

    @cached_property
    def gram(self) -> np.ndarray:
        flat = self.words.reshape(-1, self.words.shape[-1])
        return flat @ flat.T

    @cached_property
    def squares(self) -> np.ndarray:
        return np.diag(self.gram).copy()

    @classmethod
    def fit(cls, x: np.ndarray, levels: int = LEVELS, words: int = WORDS, rounds: int = 8, seed: int = 0) -> Codebooks:
        rng, left, books = np.random.default_rng(seed), x.astype(np.float32).copy(), []
        words = min(words, len(x))
        for _ in range(levels):
            book = left[rng.choice(len(left), words, replace=False)].copy()
            for _ in range(rounds):
                near = (left @ book.T - (book**2).sum(1) / 2).argmax(1)
                order = np.argsort(near, kind="stable")
                hit, at = np.unique(near[order], return_index=True)
                sums = np.add.reduceat(left[order], at, axis=0)
                book[hit] = sums / np.diff(np.append(at, len(near)))[:, None]
            near = (left @ book.T - (book**2).sum(1) / 2).argmax(1)
            left -= book[near]
            books.append(book)
        return cls(np.stack(books))

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, levels) and the norms of the reconstructions."""
        levels, words, _ = self.words.shape
        n = len(x)
        product = x.astype(np.float32) @ self.words.reshape(levels * words, -1).T
        codes = np.zeros((n, 1, 0), np.int64)
        cost = np.zeros((n, 1), np.float32)  # |x - y|^2 - |x|^2
        for level in range(levels):
            own = slice(level * words, (level + 1) * words)
            add = self.squares[own] - 2 * product[:, None, own]
            step = cost[:, :, None] + add
            for done in range(level):
                step = step + 2 * self.gram[codes[:, :, done] + done * words, own]
            flat = step.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            cost = np.take_along_axis(flat, best, 1)
            codes = np.concatenate(
                [np.take_along_axis(codes, (best // words)[:, :, None], 1), (best % words)[:, :, None]], axis=2
            )
        pick = cost.argmin(1)
        out = codes[np.arange(n), pick]
        made = self.words[np.arange(levels), out].sum(1)
        return out.astype(np.uint8), np.linalg.norm(made, axis=1).astype(np.float32)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products (levels, words, queries) of the queries with all codewords."""
        levels, words, dim = self.words.shape
        return (self.words.reshape(-1, dim) @ queries.T.astype(np.float32)).reshape(levels, words, -1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec (array of double) of the vectors that take part."""
    vec = F.col(vec_col).cast("array<double>")
    ok = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
        .where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
        .where(ok & F.exists("vec", lambda v: v != 0))
    )


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_sample(vectors: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """At most ``rows`` unit vectors, those of the least seeded hash, of the most common dimension."""
    sample = vectors.orderBy(F.xxhash64(F.lit(11), "vec_id"), "vec_id").limit(rows).toArrow()
    lists = sample.column("vec").to_pylist()
    if not lists:
        return np.zeros((0, 0))
    dim = Counter(map(len, lists)).most_common(1)[0][0]
    return _unit(np.array([v for v in lists if len(v) == dim]))


def _errors(books: Codebooks, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Angles between unit vectors and their reconstructions; pi where there is none."""
    made = books.words.astype(np.float64)[np.arange(codes.shape[1]), codes].sum(1)
    norm = np.linalg.norm(made, axis=1)
    there = norm > 1e-3
    cosines = np.einsum("ij,ij->i", made, x) / np.where(there, norm, 1)
    return np.where(there, np.arccos(np.clip(cosines, -1, 1)) + 1e-7, np.pi)


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, **sizes):
    """(codebooks, codes): the written codes are vec_id, codes, norm, error and vec."""
    used = written(usable(vectors, id_col, vec_col).groupBy("vec_id").agg(F.min("vec").alias("vec")), "vectors")
    sample = fit_sample(used, sample_rows)
    if not len(sample):
        return None, None
    books = Codebooks.fit(sample, **sizes)
    dim = sample.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                unit = _unit(_matrix(some.column(1)))
                codes, norms = books.encode(unit)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(_errors(books, unit, codes)), some.column(1)],
                    names=["vec_id", "codes", "norm", "error", "vec"],
                )

    used = used.where(F.size("vec") == dim)
    codes = used.mapInArrow(run, "vec_id long, codes binary, norm float, error double, vec array<double>")
    return books, written(codes, "codes")


def _best(scores: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the ``keep`` best of each row; equal scores by the smaller column."""
    n = scores.shape[1]
    bits = scores.astype(np.float32).view(np.uint32)
    ordered = np.where(bits >> 31 == 1, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
    keys = (ordered << np.uint64(32)) | np.arange(n - 1, -1, -1, dtype=np.uint64)
    if n > keep:
        return np.argpartition(keys, n - keep, axis=1)[:, n - keep :]
    return np.broadcast_to(np.arange(n), scores.shape)


def _dots(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of columns ``i`` of ``x`` and ``j`` of ``y``, summed in the order of the components, as ``cosine`` does."""
    out = np.zeros(len(i))
    for p, q in zip(x, y, strict=True):
        out += p[i] * q[j]
    return out


def _scan(query_ids: np.ndarray, sent, rerank: int, k: int):
    """Of the ``rerank`` best guesses in a task the ``k`` nearest by exact cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, queries = sent.value
        table, n = books.tables(_unit(queries)), len(query_ids)
        queries, each = np.ascontiguousarray(queries.T), np.arange(n)
        length = np.sqrt(_dots(queries, each, queries, each))
        held_ids, held, near = np.zeros((n, 0), np.int64), np.zeros((n, 0), np.float32), np.zeros((n, 0))
        for batch in batches:
            order = np.argsort(batch.column(0).to_numpy())
            ids = batch.column(0).to_numpy()[order]
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            norms = np.maximum(batch.column(2).to_numpy()[order], 1e-12)
            vecs, every = np.ascontiguousarray(_matrix(batch.column(4))[order].T), np.arange(len(ids))
            lengths = np.sqrt(_dots(vecs, every, vecs, every))
            for at in range(0, len(ids), SCAN_ROWS):
                part = slice(at, at + SCAN_ROWS)
                score = np.zeros((len(ids[part]), n), np.float32)
                for level in range(len(table)):
                    score += table[level][codes[part, level]]
                score = (score / norms[part, None]).T
                score = np.where(query_ids[:, None] == ids[part], np.float32(-9), score)
                best = _best(score, rerank)
                guess, exact = np.take_along_axis(score, best, 1), np.full(best.shape, -9.0)
                # Guesses below all that are held stay out and need no exact cosine.
                enter = (guess > -5) & (guess >= held.min(axis=1, initial=9)[:, None] if held.shape[1] >= rerank else True)
                i, j = np.nonzero(enter)
                place = best[i, j] + at
                exact[i, j] = _dots(queries, i, vecs, place) / (length[i] * lengths[place])
                both_ids, both = np.concatenate([held_ids, ids[part][best]], axis=1), np.concatenate([held, guess], axis=1)
                both_near = np.concatenate([near, exact], axis=1)
                by_id = np.argsort(both_ids, axis=1, kind="stable")
                both_ids, both, both_near = (np.take_along_axis(x, by_id, 1) for x in (both_ids, both, both_near))
                best = _best(both, rerank)
                held_ids, held, near = (np.take_along_axis(x, best, 1) for x in (both_ids, both, both_near))
        i, j = np.nonzero(held > -5)
        order = np.lexsort((held_ids[i, j], -near[i, j], i))
        i, j = i[order], j[order]
        first = np.arange(len(i)) - np.searchsorted(i, each)[i] < k
        i, j = i[first], j[first]
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[i]), pa.array(held_ids[i, j]), pa.array(near[i, j])], names=["query_id", "vec_id", "score"])

    return run


def _within(query_ids: np.ndarray, sent, k: int):
    """The ``k`` nearest in a task of all vectors that may be as near as each query's limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, queries, limit = sent.value
        table, n, limit = books.tables(_unit(queries)), len(query_ids), limit.copy()
        queries, each = np.ascontiguousarray(queries.T), np.arange(n)
        length = np.sqrt(_dots(queries, each, queries, each))
        held_of, held_ids, held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        step = max(1, PAIRS // n)
        for batch in batches:
            ids, errors, norms = (batch.column(c).to_numpy() for c in (0, 3, 2))
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(ids), -1)
            norms, vecs = np.maximum(norms, 1e-12), np.ascontiguousarray(_matrix(batch.column(4)).T)
            every = np.arange(len(ids))
            lengths = np.sqrt(_dots(vecs, every, vecs, every))
            for at in range(0, len(ids), step):
                part = slice(at, at + step)
                score = np.zeros((len(ids[part]), n), np.float32)
                for level in range(len(table)):
                    score += table[level][codes[part, level]]
                widest = np.minimum(np.arccos(np.clip(limit, -1, 1)) + 1e-7 + errors[part, None], np.pi)
                may = score / norms[part, None] + ROUNDING >= np.cos(widest)
                i, j = np.nonzero(may & (ids[part, None] != query_ids))
                i += at
                exact = _dots(queries, j, vecs, i) / (length[j] * lengths[i])
                near = ~(exact < limit[j])
                held_of = np.concatenate([held_of, j[near]])
                held_ids, held = np.concatenate([held_ids, ids[i[near]]]), np.concatenate([held, exact[near]])
                order = np.lexsort((held_ids, -held, held_of))
                first = np.searchsorted(held_of[order], each)
                place = np.arange(len(order)) - first[held_of[order]]
                order, place = order[place < k], place[place < k]
                held_of, held_ids, held = held_of[order], held_ids[order], held[order]
                last = place == k - 1
                limit[held_of[last]] = np.maximum(limit[held_of[last]], held[last])
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[held_of]), pa.array(held_ids), pa.array(held)], names=["query_id", "vec_id", "score"]
        )

    return run


def search(
    vectors: DataFrame, is_query, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding",
    rerank: int = RERANK, query_block: int = QUERY_BLOCK, complete: bool = True, **index,
) -> DataFrame:
    """The ``k`` nearest of every vector for which ``is_query`` (a condition
    on vec_id) holds: query_id, rank, vec_id, score.  Without ``complete`` those
    found by the codes alone, without the second scan."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    books, codes = build_index(vectors, id_col=id_col, vec_col=vec_col, **index)
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = written(codes.where(is_query).select("vec_id", "vec"), "queries")
    blocks = max(1, -(-queries.count() // query_block))
    block_of = F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(blocks))
    codes = codes.coalesce(TASKS_A_CORE * spark.sparkContext.defaultParallelism)

    def scanned(queries: DataFrame, scan) -> DataFrame:
        found = spark.createDataFrame([], schema)
        for block in range(blocks):
            rows = queries.where(block_of == block).toArrow()
            if rows.num_rows:
                found = found.union(codes.mapInArrow(scan(rows), schema))
        return found

    def guess(rows: pa.Table):
        # The codebooks and one block of queries: of a fixed size, whatever the input.
        sent = spark.sparkContext.broadcast((books, _matrix(rows.column("vec"))))
        return _scan(rows.column("vec_id").to_numpy().copy(), sent, rerank, k)

    def within(rows: pa.Table):
        sent = spark.sparkContext.broadcast((books, _matrix(rows.column("vec")), rows.column("limit").to_numpy().copy()))
        return _within(rows.column("vec_id").to_numpy().copy(), sent, k)

    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda pairs: pairs.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    first = written(best(scanned(queries, guess)), "first")
    if not complete:
        return first
    limits = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("limit"))
    # Fewer than k found set no limit.
    limited = written(queries.join(limits, "vec_id", "left").select("vec_id", "vec", F.coalesce("limit", F.lit(-2.0)).alias("limit")), "limited")
    both = first.drop("rank").union(scanned(limited, within)).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best(both)
