"""Evaluation of a model: completions, grading, report and predictions.

A provider gives the completions: called with the problems and the settings it
returns them with a column ``generated``.  Nothing here loads a model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_think
from ..sources.jsonl import suffixed, write_jsonl
from . import assemble, metrics, report
from .grade import grade


@dataclass(frozen=True)
class Settings:
    """What a provider is asked for (fixed values: the defaults); no system text at all is ''."""

    temperature: float = 0.6
    top_p: float = 0.95
    max_new_tokens: int = 4096
    max_samples: int = 0
    clean_tags: bool = False
    system: str | None = None
    repetition_max_repeats: int | None = None
    repetition_min_len: int = 4


#: Fixed value: a base model is told what the trained ones were; it has no tags to clean.
BASELINE = replace(Settings(), system="Solve the problem step by step. Show your reasoning clearly. Put your final answer in \\boxed{}.")

Provider = Callable[[DataFrame, Settings], DataFrame]


def predict(problems: DataFrame, provider: Provider, settings: Settings = Settings(), *, math: bool = False, order: str = "problem") -> DataFrame:
    """problem, ground_truth, generated, final_answer, status, is_correct, type and level of each
    problem (problem, answer, type, level), or of the first ``max_samples`` in order."""
    some = assemble.prefix(problems, order, settings.max_samples)
    made = provider(some, settings)
    text = strip_think(F.col("generated")) if settings.clean_tags else F.col("generated")
    # One truth a problem, the last in order, as in grading.
    truth = some.groupBy("problem").agg(F.max_by("answer", order).alias("ground_truth"))
    graded = grade(made.drop("answer").withColumn("answer", text), truth, math)
    return graded.select("problem", "ground_truth", F.col("answer").alias("generated"), "final_answer", "status", "is_correct", "type", "level")


def evaluate(
    problems: DataFrame, provider: Provider, settings: Settings = Settings(), *, dataset: str, math: bool = False, order: str = "problem",
    output: str | None = None, report_path: str | None = None,
) -> tuple[dict, str]:
    """Counters and report of one dataset; predictions go to ``output`` as JSON Lines, the report to ``report_path``.

    The predictions are kept while they are counted, so that a model runs once.
    """
    predictions = predict(problems, provider, settings, math=math, order=order).persist()
    try:
        total = metrics.summary(predictions).first().asDict()
        groups = {g: [{**r.asDict(), "name": r[g]} for r in metrics.summary(predictions.where(f"coalesce({g}, '') <> ''"), g).collect()] for g in ("type", "level")}
        text = report.full_report(f"{dataset.upper()} evaluation", {**total, "non_numeric": None} if math else total, types=groups["type"], levels=groups["level"])
        if output:
            write_jsonl(predictions.drop("status"), output)
        if report_path:
            report.write_text(problems.sparkSession, text, report_path)
        return {"dataset": dataset, **total}, text
    finally:
        predictions.unpersist()


def evaluate_all(
    datasets: dict[str, tuple[DataFrame, bool]], provider: Provider, settings: Settings = Settings(), *, order: str = "problem",
    output: str | None = None, report_path: str | None = None,
) -> dict[str, dict]:
    """:func:`evaluate` for each dataset (problems, math), paths suffixed by its name."""
    done = {}
    for name, (problems, math) in datasets.items():
        paths = {k: suffixed(v, name) if v else None for k, v in (("output", output), ("report_path", report_path))}
        done[name] = evaluate(problems, provider, settings, dataset=name, math=math, order=order, **paths)[0]
    return done
