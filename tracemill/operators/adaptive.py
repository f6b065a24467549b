"""Adaptive sampling around a pluggable provider of completions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_think

SAMPLE = "problem string, answer string, sample_idx int, token_logprobs array<double>"


def mean_logprob(tokens: Column) -> Column:
    """Mean of the usable values; null without any."""
    usable = F.filter(tokens, lambda x: x.isNotNull())
    return F.when(F.size(usable) > 0, F.aggregate(usable, F.lit(0.0), lambda s, v: s + v) / F.size(usable))


def confident(means: Column, threshold: float = -1.8) -> Column:
    """Whether the largest mean reaches the threshold; false without any."""
    return F.coalesce(F.array_max(F.filter(means, lambda x: x.isNotNull())) >= threshold, F.lit(False))


def adaptive_sample(
    problems: DataFrame, provider: Callable[[DataFrame, float, int, int], DataFrame], *, t_low: float = 0.3, t_high: float = 0.9,
    n_low: int = 3, n_per_iter: int = 2, max_iters: int = 4, threshold: float = -1.8,
) -> DataFrame:
    """Samples of all rounds, without what models think aloud.  ``provider(problems,
    temperature, n, round)`` gives rows of ``SAMPLE``; problems with a mean
    log-probability, of any round so far, that reaches the threshold leave.  Rows of
    equal ``problem`` are one problem.  A round is written once."""
    problems, out = problems.select("problem").distinct(), None
    todo = problems
    for turn in range(1, max_iters + 2):
        temperature, n = (t_low, n_low) if turn == 1 else (t_high, n_per_iter)
        made = provider(todo, temperature, n, turn).withColumns({
            "answer": strip_think(F.col("answer")), "round": F.lit(turn), "temperature": F.lit(temperature),
            "mean": mean_logprob(F.col("token_logprobs")),
        }).checkpoint()
        out = made if out is None else out.unionByName(made)
        todo = problems.join(out.where(F.col("mean") >= threshold), "problem", "left_anti")
        if turn > max_iters or todo.isEmpty():
            break
    return out.select("problem", "answer", "temperature", "round", "sample_idx", "token_logprobs", "mean")


def confidence_by_round(samples: DataFrame, threshold: float = -1.8) -> DataFrame:
    """For each round (as of :func:`adaptive_sample`): the problems sampled, and how many of them
    have reached the threshold with it (high) or not (low), with shares."""
    first = F.min(F.when(F.col("mean") >= threshold, F.col("round"))).alias("reached")
    per = samples.groupBy("problem").agg(first, F.max("round").alias("last"))
    rounds = per.select(F.explode(F.sequence(F.lit(1), "last")).alias("round"), (F.col("reached") == F.col("round")).alias("sure"))
    share = lambda c: F.round(c / F.count("*") * 100, 6)
    high = F.count_if(F.coalesce("sure", F.lit(False)))
    return rounds.groupBy("round").agg(
        F.count("*").alias("problems"), high.alias("high"), (F.count("*") - high).alias("low"),
        share(high).alias("high_pct"), share(F.count("*") - high).alias("low_pct"),
    )
