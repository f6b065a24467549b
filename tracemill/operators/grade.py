"""Grading: join with the truth, classify, and split outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compare import is_numeric, number_value
from ..functions.text import squeeze, with_final_answer


def last_truth(truth: DataFrame, order: str = "ord") -> DataFrame:
    """One answer a problem: that of the last row."""
    return truth.groupBy("problem").agg(F.max_by("answer", order).alias("ground_truth"))


def grade(samples: DataFrame, truth: DataFrame, math: bool = False) -> DataFrame:
    """``samples`` (problem, answer, ...) with final_answer, ground_truth,
    status (empty, non_numeric, valid) and is_correct.

    ``truth`` has one row a problem; Spark broadcasts it if it is small.
    """
    columns = [*samples.columns, "final_answer", "ground_truth", "status", "is_correct"]
    status = F.when(F.col("final_answer") == "", "empty")
    if not math:
        status = status.when(~is_numeric(F.col("final_answer")), "non_numeric")
    value = squeeze if math else number_value
    answered = with_final_answer(samples, math=math).withColumn("status", status.otherwise("valid"))
    answered = answered.withColumn("_value", F.when(F.col("status") == "valid", value(F.col("final_answer"))))
    truth = truth.select("problem", "ground_truth", value(F.col("ground_truth")).alias("_truth"))
    equal = F.col("_value") == F.col("_truth") if math else F.abs(F.col("_value") - F.col("_truth")) < 1e-9
    return answered.join(truth, "problem", "left").withColumn("is_correct", F.coalesce(equal, F.lit(False))).select(*columns)


def comparable(graded: DataFrame, math: bool = False) -> DataFrame:
    """Valid rows with a truth that compares: the correct and the incorrect ones."""
    out = graded.where("status = 'valid' and ground_truth is not null")
    return out if math else out.where(number_value(F.col("final_answer")).isNotNull() & number_value(F.col("ground_truth")).isNotNull())


def correct_rows(graded: DataFrame) -> DataFrame:
    return graded.where("is_correct")


def incorrect_rows(graded: DataFrame, adaptive: bool = False, math: bool = False) -> DataFrame:
    """Graded wrong.  ``adaptive`` counts non-numeric rows and missing truths too."""
    rows = graded.where("status <> 'empty'") if adaptive else comparable(graded, math)
    return rows.where("not is_correct").withColumnRenamed("answer", "teacher_answer")


def empty_rows(rows: DataFrame) -> DataFrame:
    """Rows in which no answer was found."""
    return rows.where(F.coalesce("final_answer", F.lit("")) == "")


def bad_rows(rows: DataFrame) -> DataFrame:
    return rows.where(~is_numeric(F.coalesce("final_answer", F.lit(""))))


def missing_truth(graded: DataFrame) -> DataFrame:
    return graded.where("ground_truth is null").select("problem").distinct()


def error_correction_set(student: DataFrame, teacher: DataFrame) -> DataFrame:
    """Problems that the student got wrong and the teacher right."""
    right = teacher.where("is_correct").select("problem").distinct()
    wrong = student.groupBy("problem").agg(F.bool_or("is_correct").alias("any")).where("not any").select("problem")
    return wrong.join(right, "problem", "left_semi")
