"""JSON Lines sources and sinks, loaders and the dataset registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import hash_answer, last_boxed_content, strip
from ..operators.assemble import split

PROBLEM = T.StructType().add("problem", "string").add("answer", "string").add("type", "string").add("level", "string")
ADAPTIVE = T.StructType().add("problem", "string").add("answer", "string").add("temperature", "double").add("round", "integer").add("sample_idx", "integer")
RAW_HASH = T.StructType().add("question", "string").add("answer", "string")
RAW_BOXED = T.StructType().add("problem", "string").add("solution", "string").add("type", "string").add("level", "string")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """One JSON object a line; blank lines are skipped, malformed ones fail if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines that are not blank, as they are."""
    return spark.read.text(path).where(strip(F.col("value")) != "")


def read_export(spark: SparkSession, path: str, schema: T.StructType = RAW_BOXED) -> DataFrame:
    """A dataset as a hub exports it: Parquet, or JSON Lines where the path ends so; fields it lacks are null."""
    rows = read_jsonl(spark, path, schema) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)
    there = {c.lower() for c in rows.columns}
    return rows.select(*[F.col(f.name).cast(f.dataType) if f.name.lower() in there else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


#: What absent fields of a record stand for.
DEFAULTS = {"final_answer": "", "round": 0, "type": "", "level": ""}


def with_defaults(rows: DataFrame, **defaults) -> DataFrame:
    """``rows`` with ``DEFAULTS`` (or those given) for fields that are null or absent."""
    defaults = defaults or DEFAULTS
    return rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in rows.columns else F.lit(v) for k, v in defaults.items()})


def write_jsonl(df: DataFrame, path: str, explicit_nulls: bool = False, append: bool = False) -> None:
    """One object a line; ``append`` adds files to those there are, each committed whole."""
    df.write.mode("append" if append else "errorifexists").option("ignoreNullFields", str(not explicit_nulls).lower()).json(path)


def fan_out(graded: DataFrame, outputs: dict[str, tuple[str, F.Column]], drop: tuple[str, ...] = ()) -> dict[str, int]:
    """Write the rows of each condition to its path; those without rows write nothing."""
    graded = graded.persist()
    try:
        counts = graded.agg(*[F.count_if(condition).alias(name) for name, (_, condition) in outputs.items()]).first().asDict()
        for name, (path, condition) in outputs.items():
            if counts[name]:
                write_jsonl(graded.where(condition).drop(*drop), path)
        return counts
    finally:
        graded.unpersist()


def load_hash(raw: DataFrame) -> DataFrame:
    """Problems whose answer follows ``####``; rows without one are dropped."""
    return raw.select(F.col("question").alias("problem"), hash_answer(F.col("answer")).alias("answer")).where("answer is not null")


def load_boxed(raw: DataFrame) -> DataFrame:
    """Problems whose answer is the last boxed content; rows without one are dropped."""
    answer = last_boxed_content(F.col("solution")).alias("answer")
    return raw.select("problem", answer, "type", "level").where("answer is not null")


def split_boxed(raw: DataFrame, train: str, test: str, *, train_share: float = 0.9, seed: int = 42) -> dict[str, int]:
    """Load, shuffle by the seed, and write the first ``train_share`` to ``train``, the rest to ``test``;
    the numbers of rows written and skipped."""
    # Rows equal in problem and answer are the same row to whoever reads them.
    rows = load_boxed(raw).withColumn("_key", F.to_json(F.struct("problem", "answer", "type", "level"))).withColumn("_id", F.monotonically_increasing_id())
    cut = split(rows.persist(), "_key", train_share, seed, tie="_id").drop("_key", "_id")
    done = fan_out(cut, {"train": (train, F.col("part") == "train"), "test": (test, F.col("part") == "test")}, drop=("part",))
    rows.unpersist()
    return {**done, "missing": raw.count() - sum(done.values())}


def missing(raw: DataFrame, loaded: DataFrame) -> int:
    return raw.count() - loaded.count()


#: Datasets by key: input and output names.
DATASETS = {"gsm8k": ("gsm8k_train", "gsm8k_cot"), "math": ("math_train", "math_cot")}


def suffixed(path: str, dataset: str) -> str:
    """``report.txt`` for one of several datasets: ``report_gsm8k.txt``."""
    stem, dot, ending = path.rpartition(".")
    return f"{stem}_{dataset}.{ending}" if dot else f"{path}_{dataset}"
