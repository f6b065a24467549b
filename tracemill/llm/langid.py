"""Language identification by hyperdimensional profiles.

Every letter has a random bipolar vector, fixed by its code point and a seed.
The vectors of three letters in a row, rotated by place, are bound by
multiplication into a trigram vector; a text is the bundle (sum) of its trigram
vectors, a language the bundle of its texts.  A text's language is the prototype
of the largest cosine.  Bundles are integers, so they come out alike in any
order of summation.

Defined results
    null text, or text without a letter: ``und`` with score 0.  Otherwise the
    score is the cosine, at least 0; ties go to the first label in order.  With
    no labelled row at all every text is ``und``.  Repeated rows are predicted
    alike; rows of null id are never learned from and count as not held out.
    Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSION = 1024
SEED = 7
#: Labelled rows of a language that its prototype is learned from, about.
ROWS_A_LANGUAGE = 2_000
BATCH = 128
#: Trigrams that are turned into vectors at once.
COLUMNS = 4_096
UND = "und"


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Space:
    """The letter vectors met so far, and bundles of texts."""

    def __init__(self, dimension: int, seed: int):
        self.dimension, self.seed = dimension, seed
        self.index: dict[int, int] = {}
        self.letters = [np.zeros((0, dimension), np.int8)] * 3

    def _at(self, points: np.ndarray) -> np.ndarray:
        """Rows of the letters; unseen ones are drawn from their own seeds."""
        distinct, inverse = np.unique(points, return_inverse=True)
        new = [int(p) for p in distinct if int(p) not in self.index]
        if new:
            drawn = np.stack([np.random.Generator(np.random.PCG64([self.seed, p])).integers(0, 2, self.dimension) for p in new])
            drawn = (2 * drawn - 1).astype(np.int8)
            for p in new:
                self.index[p] = len(self.index)
            self.letters = [np.concatenate([old, np.roll(drawn, k, axis=1)]) for k, old in enumerate(self.letters)]
        return np.array([self.index[int(p)] for p in distinct])[inverse]

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A bundle (float64, whole numbers) for each text, and which texts have letters."""
        codes, owner = [], []
        has = np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = _is_letter()[points]
            has[k] = letter.any()
            if not has[k]:
                continue
            x = np.concatenate([[32], np.where(letter, points, 32), [32]]).astype(np.int64)
            x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
            codes.append((x[:-2] << 42) | (x[1:-1] << 21) | x[2:])
            owner.append(np.full(len(x) - 2, k))
        out = np.zeros((len(texts), self.dimension))
        if not codes:
            return out, has
        distinct, inverse = np.unique(np.concatenate(codes), return_inverse=True)
        n = len(distinct)
        cells, counts = np.unique(np.concatenate(owner) * n + inverse, return_counts=True)
        row, col = cells // n, cells % n
        mask = (1 << 21) - 1
        for at in range(0, n, COLUMNS):
            some = distinct[at : at + COLUMNS]
            first, second, third = (self._at(p) for p in (some >> 42, (some >> 21) & mask, some & mask))
            vectors = self.letters[2][first] * self.letters[1][second] * self.letters[0][third]
            here = (col >= at) & (col < at + COLUMNS)
            table = np.zeros((len(texts), len(some)), np.float32)
            table[row[here], col[here] - at] = counts[here]
            out += table @ vectors.astype(np.float32)
        return out, has


@cache
def _space(dimension: int, seed: int) -> Space:
    return Space(dimension, seed)


def held_out(doc_id) -> F.Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, *, dimension: int = DIMENSION, seed: int = SEED, rows_a_language: int = ROWS_A_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Labels and prototypes from a seeded sample of the rows that may be learned from.

    The sample holds ``rows_a_language`` rows of a language in expectation, or
    all where there are fewer.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", "lang", "text")
    # As many rows as there are labels.
    share = {r[0]: min(1.0, rows_a_language / r[1]) for r in usable.groupBy("lang").count().collect()}
    if not share:
        return [], np.zeros((0, dimension))
    limits = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(int(v * 2**30)))])
    chosen = usable.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**30)) < limits[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = _space(dimension, seed), {}
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                langs = batch.column(0).slice(at, BATCH).to_pylist()
                made, _ = space.bundles(batch.column(1).slice(at, BATCH).to_pylist())
                for lang, one in zip(langs, made.astype(np.int64), strict=True):
                    sums[lang] = sums[lang] + one if lang in sums else one
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([list(v) for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "sums"]
            )

    rows = (
        chosen.select("lang", "text").mapInArrow(run, "lang string, sums array<long>")
        .select("lang", F.posexplode("sums").alias("at", "value"))
        .groupBy("lang", "at").agg(F.sum("value").alias("value"))
        .collect()  # labels x dimension
    )
    labels = sorted(share)
    out = np.zeros((len(labels), dimension))
    for lang, at, value in rows:
        out[labels.index(lang), at] = value
    return labels, out


def predict(docs: DataFrame, labels: list[str], prototypes: np.ndarray, *, text_col: str = "text", seed: int = SEED, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row with lang_pred and score; only the text is looked at."""
    dimension = prototypes.shape[1]
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = prototypes / np.where(norms == 0, 1, norms)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = _space(dimension, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                made, has = space.bundles(part.column(part.num_columns - 1).to_pylist())
                sizes = np.linalg.norm(made, axis=1, keepdims=True)
                if len(labels):
                    cos = (made / np.where(sizes == 0, 1, sizes)) @ unit.T
                    best = cos.argmax(1)
                    score = np.where(has, np.clip(cos[np.arange(len(best)), best], 0, 1), 0.0)
                    names = [labels[b] if h else UND for b, h in zip(best, has, strict=True)]
                else:
                    score, names = np.zeros(part.num_rows), [UND] * part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(names, pa.string()), pa.array(score)], names=[*part.schema.names[:-1], "lang_pred", "score"]
                )

    return docs.select(*keep, F.col(text_col)).mapInArrow(run, schema)
