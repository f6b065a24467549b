"""Byte-level BPE encoding and decoding over Arrow batches.

The model is built in the ``tokenizers`` library from a file of ranks; every
match of the pattern is encoded by itself.  Decoding looks each id up in the
byte table, so that characters split over several ids come back whole.

Defined results
    a null or empty text has no ids and decodes to no bytes; special tokens'
    strings are ordinary text; repeated rows give repeated results; an empty
    input gives no rows.  Input columns are not passed on, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import byte_bpe

BATCH = 256
ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>"


def _texts(column, at: int) -> list[str]:
    return [t or "" for t in column.slice(at, BATCH).to_pylist()]


def encode(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, offsets: bool = False) -> DataFrame:
    """Ids of each text: doc_id, ids, and with ``offsets`` the character spans
    [starts, ends) of each id; else these are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                texts = _texts(batch.column(1), at)
                ids = bpe.batch(texts)
                spans = [bpe.spans(t, i) for t, i in zip(texts, ids, strict=True)] if offsets else None
                none = pa.nulls(len(texts), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, BATCH).cast(pa.int64()),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array([[a for a, _ in s] for s in spans], pa.list_(pa.int32())) if spans else none,
                        pa.array([[b for _, b in s] for s in spans], pa.list_(pa.int32())) if spans else none,
                    ],
                    names=["doc_id", "ids", "starts", "ends"],
                )

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id and the bytes of its ids; a null list gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            data = [None if i is None else bpe.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip_digests(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """Encode and decode every text in one pass and keep digests only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        spelt = [str(i) for i in range(len(bpe.table))]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                ids = bpe.batch(_texts(batch.column(1), at))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, BATCH).cast(pa.int64()),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([sha(",".join(map(spelt.__getitem__, i)).encode()) for i in ids]),
                        pa.array([sha(bpe.decode(i)) for i in ids]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
