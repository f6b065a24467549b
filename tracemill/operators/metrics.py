"""Counters, rates and tables over graded rows and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .dedup import positions


def counters() -> list[Column]:
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    return [
        F.count("*").alias("total"), n("status = 'empty'", "empty"), n("status = 'non_numeric'", "non_numeric"),
        n("status = 'valid'", "valid"), n("is_correct", "correct"),
    ]


def percent(part: Column, whole: Column) -> Column:
    """0 where the whole is."""
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


def rates(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "incorrect": F.col("valid") - F.col("correct"),
            "accuracy": F.round(percent(F.col("correct"), F.col("total")), 6),
            "valid_accuracy": F.round(percent(F.col("correct"), F.col("valid")), 6),
        }
    )


def summary(graded: DataFrame, *by: str) -> DataFrame:
    return rates(graded.groupBy(*by).agg(*counters()))


def category_report(graded: DataFrame) -> DataFrame:
    """All, by type and by level in one pass."""
    sets = graded.groupingSets([[], ["type"], ["level"]], "type", "level").agg(*counters(), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "type").otherwise("level")
    name = F.when(F.col("g") == 3, "").otherwise(F.coalesce("type", "level"))
    return rates(sets.select(kind.alias("kind"), name.alias("name"), "total", "empty", "non_numeric", "valid", "correct")).where("name is not null")


def problem_level(graded: DataFrame) -> DataFrame:
    """Problems with truth: all, any, none of whose samples are correct; and without."""
    per = graded.groupBy("problem").agg(
        F.bool_and("is_correct").alias("every"), F.bool_or("is_correct").alias("some"),
        F.max(F.col("ground_truth").isNotNull()).alias("known"), F.count("*").alias("n"),
    )
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    return per.agg(
        F.count("*").alias("problems"), n("known", "with_truth"), n("known and every", "all_correct"),
        n("known and some", "any_correct"), n("known and not some", "none_correct"),
        F.round(F.sum("n") / F.count("*"), 6).alias("avg_samples"),
    )


def group_sizes(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def similarity_stats(pairs: DataFrame, x: str = "sim") -> DataFrame:
    made = {"low": F.min(x), "high": F.max(x), "mean": F.avg(x), "std": F.stddev_pop(x)}
    stats = pairs.agg(F.count("*").alias("n"), *[F.round(v, 6).alias(k) for k, v in made.items()])
    n = pairs.count()
    # The one or two in the middle of the order.
    middle = positions(pairs.select(x), x).where(F.col("pos").isin((n + 1) // 2, n // 2 + 1)).agg(F.round(F.avg(x), 6).alias("mid"))
    return stats.join(F.broadcast(middle)).select("n", "low", "high", "mean", "mid", "std")


def length_stats(rows: DataFrame, by: str, text: str = "answer") -> DataFrame:
    """Characters of the texts of each file: rows, sum and mean."""
    n = F.length(F.coalesce(text, F.lit("")))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("mean_chars"))


#: Bounds of the similarity bins, half open.
BINS = (0.0, 0.5, 0.7, 0.8, 0.85, 0.9, 0.92, 0.95, 0.97, 0.98, 0.99, 1.0)


def similarity_histogram(pairs: DataFrame, x: str = "sim", bins: tuple[float, ...] = BINS) -> DataFrame:
    """Pairs in each bin, empty bins included; values outside all bins count nowhere."""
    table = pairs.sparkSession.createDataFrame(list(zip(bins, bins[1:], strict=False)), "lo double, hi double")
    bucket = F.coalesce(*[F.when((F.col(x) >= lo) & (F.col(x) < hi), F.lit(lo)) for lo, hi in zip(bins, bins[1:], strict=False)])
    counted = pairs.groupBy(bucket.alias("lo")).agg(F.count("*").alias("n"))
    return F.broadcast(table).join(counted, "lo", "left").select("lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


SELF_CORRECTION = ("wait", "Oops", "Actually,", "Hmm", "I made a mistake")


def quality_flags(rows: DataFrame, text: str = "text") -> DataFrame:
    """Flags of low quality of a trace; a null text has all but those of absence false."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != "")
    # Of four equal lines the first and the last are three apart in order.
    ordered = F.array_sort(lines)
    fourfold = F.exists(F.zip_with(ordered, F.slice(ordered, 4, F.greatest(F.size(lines), F.lit(1))), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False)))
    count_of = lambda s: F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))
    return rows.withColumns(
        {
            "self_correction": F.exists(F.array(*map(F.lit, SELF_CORRECTION)), lambda s: F.contains(t, s)),
            # Four equal lines can only be where distinct ones are three fewer.
            "repeated_lines": F.when(F.size(lines) - F.size(F.array_distinct(lines)) >= 3, fourfold).otherwise(False),
            "no_boxed": ~F.contains(t, F.lit("\\boxed{")),
            "extreme_length": (F.length(t) < 200) | (F.length(t) > 3000),
            "artifacts": (count_of("$$") / 2 % 2 == 1) | (count_of("[") != count_of("]")),
        }
    )


FLAGS = ("self_correction", "repeated_lines", "no_boxed", "extreme_length", "artifacts")


def quality_table(flagged: DataFrame, by: str, text: str = "text") -> DataFrame:
    return flagged.groupBy(by).agg(
        F.count("*").alias("total"), *[F.count_if(f).alias(f) for f in FLAGS],
        *[F.round(F.count_if(f) / F.count("*") * 100, 6).alias(f"{f}_pct") for f in FLAGS],
        F.round(F.avg(F.length(text)), 6).alias("mean_chars"),
    )


def coverage(graded: DataFrame, by: str) -> DataFrame:
    """Problems with a correct sample over all, and samples for each covered one."""
    per = graded.groupBy(by, "problem").agg(F.bool_or("is_correct").alias("covered"), F.count("*").alias("n"))
    return per.groupBy(by).agg(
        F.count("*").alias("problems"), F.count_if("covered").alias("covered"),
        F.round(F.count_if("covered") / F.count("*") * 100, 6).alias("coverage"),
        F.round(F.sum("n") / F.nullif(F.count_if("covered"), F.lit(0)), 6).alias("samples_per_covered"),
    )


def model_pivot(graded: DataFrame, models: list[str]) -> DataFrame:
    """Accuracy by type, one column a model, and the best model."""
    table = graded.groupBy("type").pivot("model", models).agg(F.round(F.avg(F.col("is_correct").cast("int")) * 100, 6))
    best = F.array_max(F.array(*[F.struct(F.coalesce(m, F.lit(-1.0)).alias("v"), F.lit(m).alias("m")) for m in models]))
    return table.withColumn("best", best["m"])


def baseline_delta(metrics: DataFrame, baseline: str) -> DataFrame:
    """Points of accuracy above the baseline model's."""
    base = metrics.where(F.col("model") == baseline).select(F.col("accuracy").alias("base"))
    return metrics.join(F.broadcast(base.limit(1)), how="left").withColumn("delta", F.round(F.col("accuracy") - F.col("base"), 6)).drop("base")


def token_limit(rows: DataFrame, count: Column, most: int, order: str) -> DataFrame:
    """Rows at or over a limit of tokens: counts, share and the first ten of them."""
    first = rows.withColumn("over", count >= most)
    listed = first.where("over").orderBy(order).limit(10).agg(F.sort_array(F.collect_list(order)).alias("first_over"))
    return first.agg(
        F.count("*").alias("total"), F.count_if("over").alias("over_limit"), F.count_if(~F.col("over")).alias("under_limit"),
        F.round(percent(F.count_if("over"), F.count("*")), 6).alias("over_pct"),
    ).join(F.broadcast(listed))
