"""Completions by a Python function, in batches on the executors.

``generate`` takes a list of prompts (each a list of messages) and gives a list
of as many lists of completions; it is made once in a task by ``load``, so that
a model is loaded where it runs and never sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .adaptive import SAMPLE
from .assemble import prompt

Generate = Callable[[list[list[dict]]], list[list[str]]]
MESSAGES = T.ArrayType(T.StructType().add("role", "string").add("content", "string"))


def complete(rows: DataFrame, load: Callable[[], Generate], messages: str = "messages", name: str = "generated", batch: int = 32) -> DataFrame:
    """``rows`` with the first completion of each prompt; at most ``batch`` prompts a call."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])
    at = rows.columns.index(messages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = load()
        for some in batches:
            for start in range(0, some.num_rows, batch):
                part = some.slice(start, batch)
                made = generate(part.column(at).to_pylist())
                if len(made) != part.num_rows:
                    raise ValueError(f"{len(made)} completions for {part.num_rows} prompts")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([m[0] if m else None for m in made], pa.string())], names=[*part.schema.names, name])

    return rows.mapInArrow(run, schema)


def evaluated(load: Callable[[object], Generate], batch: int = 32):
    """A provider for ``evaluate``: ``load`` gets the settings."""

    def provider(problems: DataFrame, settings) -> DataFrame:
        system = settings.system or None
        asked = problems.withColumn("_messages", prompt(F.col("problem"), system).cast(MESSAGES))
        return complete(asked, lambda: load(settings), "_messages", batch=batch).drop("_messages")

    return provider


def sampled(load: Callable[[float, int], Callable], system: str | None = None, batch: int = 32):
    """A provider for ``adaptive_sample``: ``load(temperature, n)`` gives a function
    from prompts to lists of (completion, log-probabilities of its tokens)."""

    def provider(problems: DataFrame, temperature: float, n: int, turn: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            generate = load(temperature, n)
            for some in batches:
                for start in range(0, some.num_rows, batch):
                    part = some.slice(start, batch)
                    made = generate(part.column(1).to_pylist())
                    rows = [(p, text, k, lp) for p, each in zip(part.column(0).to_pylist(), made, strict=True) for k, (text, lp) in enumerate(each)]
                    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["problem", "answer", "sample_idx", "token_logprobs"])

        return problems.select("problem", prompt(F.col("problem"), system).cast(MESSAGES).alias("messages")).mapInArrow(run, SAMPLE)

    return provider
