"""Extraction and grading of samples that arrive as files (an extension: stateless)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.grade import grade


def graded_stream(spark: SparkSession, folder: str, schema: StructType, truth: DataFrame, math: bool = False) -> DataFrame:
    """A stream of graded samples from JSON files dropped into ``folder``."""
    return grade(spark.readStream.schema(schema).json(folder), truth, math)
