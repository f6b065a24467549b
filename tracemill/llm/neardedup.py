"""Near-duplicate documents by weighted MinHash.

A text's features are its shingles of five words (one shingle of all words, if
fewer), each of weight tf * idf, where a shingle's idf is the mean of its words':
``1 + ln(N / max(df, RARE * N)) / ln(1 / RARE)``, from 1 for a word of every
document to 2 for all words in fewer than ``RARE`` of the documents.  Frequencies
count all documents; those above ``RARE * N`` are what is broadcast, at most
(mean distinct words a document) / RARE entries whatever the input.

Signatures are improved consistent weighted samples; bands of them bring
documents together.  In each bucket all are compared with the first.  Buckets
whose documents then are not all in one component are compared further, block
by block: every document outside the largest component with all documents of
other components, in the first band that the two share, so that no link between
two texts of a bucket is lost and no pair is made twice.  Whatever banding brings
together is compared by weighted Jaccard similarity on all shingles, but for
pairs that a bound on it rules out (``matching.may_reach``).  Components of the
links are the classes.  The parameters of the samples are drawn for ``2 **
DRAW_BITS`` classes of shingles, not for each shingle: shingles of one class are
told apart by their weights and the hash that is kept, and agree as often as the
similarity says also in texts of 20,000 words (see the tests).

Defined results
    words are runs of letters, digits and underscores, in lower case.  Texts of
    equal words are one class; a null text, or one without words, is a class of
    its own.  The first (doc_id, row) of a class is its id and stays; null ids
    come last.  Repeated rows belong to one class.  An empty input gives no
    rows; extra columns are not read.  Give a table or a checkpoint, whose rows
    come in the same order when a lost task runs again.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, ordinal, written
from .graph import components
from .matching import candidate_links

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Words in a smaller share of documents than this weigh alike.
RARE = 1e-3
#: Parameters of the samples are drawn for so many shingle classes.
DRAW_BITS = 13
#: Shingles sampled at once.
CHUNK = 512
SEED = 17
#: Cells of a text's sketch.
CELLS = 1024
MEMO_WORDS = 300_000
_WORDS = re.compile(r"\w+").findall
_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def words_of(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Features(dict):
    """Hashes and weights of a text's shingles; the dictionary numbers the words met so far."""

    def __init__(self, frequent: dict[str, int], documents: int):
        super().__init__()
        self.frequent, self.documents = frequent, max(documents, 1)
        self.hashes, self.idfs = np.zeros(1024, np.uint64), np.zeros(1024)

    def __reduce__(self):
        return Features, (self.frequent, self.documents)

    def idf(self, word: str) -> float:
        df = self.frequent.get(word, 0)
        return 1 + math.log(self.documents / df) / math.log(1 / RARE) if df > RARE * self.documents else 2.0

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.hashes):
            self.hashes, self.idfs = np.resize(self.hashes, 2 * at), np.resize(self.idfs, 2 * at)
        self.hashes[at] = xxhash.xxh3_64_intdigest(word)
        self.idfs[at] = self.idf(word)
        self[word] = at
        return at

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes in order, and their weights."""
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0)
        if len(self) > MEMO_WORDS:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        h, w = self.hashes[at], self.idfs[at]
        k = min(SHINGLE_WORDS, len(words))
        n = len(words) - k + 1
        total, idf = h[:n] * _A[0], w[:n].copy()
        for j in range(1, k):
            total += h[j : j + n] * _A[j]
            idf += w[j : j + n]
        total = _mix(total)
        order = np.argsort(total)
        total, idf = total[order], idf[order]
        first = np.concatenate([[0], np.flatnonzero(total[1:] != total[:-1]) + 1])
        tf = np.diff(np.append(first, n))
        return total[first], tf * idf[first] / k


class Sampler:
    """Improved consistent weighted sampling: for each function, the shingle and level drawn."""

    def __init__(self, functions: int = BANDS * ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        shape = (1 << DRAW_BITS, functions)
        r, c, b = rng.gamma(2, 1, shape), rng.gamma(2, 1, shape), rng.random(shape)
        self.tables = np.stack([1 / r, b, r, np.log(c) - r * (1 - b)], axis=1).astype(np.float32)
        self.drawn = np.empty((CHUNK, 4, functions), np.float32)
        self.t, self.a = np.empty((2, CHUNK, functions), np.float32)

    def __call__(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One uint64 a function.  A shingle's draws are those of its hash's first
        bits, so that hashes in order read the tables in order."""
        at = (hashes >> np.uint64(64 - DRAW_BITS)).astype(np.int64)
        logs = np.log(weights).astype(np.float32)[:, None]
        size = self.a.shape[1]
        best, low, level = np.full(size, np.inf, np.float32), np.zeros(size, np.int64), np.zeros(size, np.float32)
        for start in range(0, len(at), CHUNK):
            n = min(CHUNK, len(at) - start)
            drawn, t, a = self.drawn[:n], self.t[:n], self.a[:n]
            np.take(self.tables, at[start : start + n], axis=0, out=drawn, mode="clip")
            np.multiply(drawn[:, 0], logs[start : start + n], out=t)
            t += drawn[:, 1]
            np.floor(t, out=t)
            np.multiply(drawn[:, 2], t, out=a)
            np.subtract(drawn[:, 3], a, out=a)
            least = a.min(axis=0)
            rows, cols = np.nonzero(a == least)
            first = np.empty(size, np.int64)
            first[cols[::-1]] = rows[::-1]  # of equal ones the first
            less = least < best
            best = np.where(less, least, best)
            low = np.where(less, first + start, low)
            level = np.where(less, t[first, np.arange(size)], level)
        return _mix(hashes[low] ^ _mix(level.astype(np.int64).astype(np.uint64) + _A[0]))


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _A[1]
    for j in range(rows.shape[1]):
        key = _mix(key + rows[:, j] * _A[j % 5])
    return key.view(np.int64)


def frequencies(numbered: DataFrame) -> tuple[dict[str, int], int]:
    """Words in more than ``RARE`` of the documents, with their counts, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["word", "df"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(set(words_of(text)))
                if len(seen) > 2 * MEMO_WORDS:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    n = numbered.count()
    least = max(RARE * n, 1)
    counts = numbered.select("text").mapInArrow(run, "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))
    return {r[0]: r[1] for r in counts.where(F.col("df") > least).collect()}, n


def signatures(numbered: DataFrame, matcher) -> DataFrame:
    """doc_id, row, digest (of the words; null without any), bands of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, sample = matcher.value.make, _sampler()
        for batch in batches:
            digests, bands = [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                drawn = sample(*make(words)) if words else None
                digests.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest() if words else None)
                bands.append(band_keys(drawn) if words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "row", "digest", "bands"],
            )

    schema = "doc_id long, row long, digest binary, bands array<long>"
    return numbered.select("doc_id", "row", "text").mapInArrow(run, schema)


@cache
def _sampler() -> Sampler:
    return Sampler()


class Matcher:
    """How two documents are compared."""

    similarity, cells = SIMILARITY, CELLS

    def __init__(self, make: Features):
        self.make = make

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.make(words_of(text))

    def features_of(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return map(self.features, texts)


def near_dedup(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, row, class_id, class_size, kept."""
    spark = docs.sparkSession
    bound_batches(spark)
    numbered = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), ordinal(docs).alias("row"), F.col(text_col).alias("text")
    )
    matcher = spark.sparkContext.broadcast(Matcher(Features(*frequencies(numbered))))
    table = written(signatures(numbered, matcher), "signatures", hashes=True)
    same = table.where("digest is not null").groupBy("digest").agg(F.min("row").alias("rep"))
    reps = written(table.join(same.select(F.col("rep").alias("row")), "row", "left_semi").select("row", "bands"), "distinct_texts", hashes=True)
    links = candidate_links(reps, numbered.select("row", "text"), matcher)
    parts = components(links.select("a", "b")).select(F.col("node").alias("rep"), "label")
    # Copies of one text take the class of their representative, part of the input by part.
    part = F.shiftright("row", 33).alias("part")
    local = (
        table.where("digest is not null").select(part, "digest").distinct()
        .join(same, "digest").join(parts, "rep", "left")
    )
    classed = (
        table.select("doc_id", "row", "digest", part)
        .join(local, ["part", "digest"], "left")
        .withColumn("class", F.coalesce("label", "rep", "row"))
        .withColumn("kind", F.when(F.col("label").isNotNull(), 1).otherwise(0))
        .select("doc_id", "row", "class", "kind", part)
    )
    classed = written(classed, "classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    tops = classed.groupBy("kind", "class").agg(F.min(order).alias("top"), F.count("*").alias("class_size"))
    near = classed.select("part", "kind", "class").distinct().join(tops, ["kind", "class"])
    return classed.join(near, ["part", "kind", "class"]).select(
        "doc_id", "row", F.col("top.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("top.row")).alias("kept")
    )
