"""Chain-of-thought samples made from the driver's tables, which hold none.

Each lineitem row is a sample of the problem ``order <key>``; its line number
selects the form of the answer, its quantity the value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt to all cores by ``key``.  The driver's tables are files of a single row group, which one task
    reads; grading and windows by the key then need no further shuffle."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def problem(key) -> F.Column:
    return F.concat(F.lit("order "), F.col(key).cast("string"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """problem, answer, q, line, part, supp, sample_idx, round, type, level, ord."""
    q = F.col("l_quantity").cast("long").cast("string")
    c = lambda *xs: F.concat(*[x if isinstance(x, F.Column) else F.lit(x) for x in xs])
    forms = {
        1: c("<think>try 7</think> So \\boxed{", q, " \\text{ units}}"),
        2: c("We get ", q, ".\n**Answer:** ", q, " units."),
        3: c("The total is ", q, "."),
        4: c("\\boxed{\\$1,00", q, "}"),
        5: c("\\boxed{\\frac{", (F.col("l_quantity").cast("long") * 2).cast("string"), "}{2}}"),
        6: c("and then ", q),
        7: c("\\boxed{x+", q, "}"),
    }
    answer = F.coalesce(*[F.when(F.col("l_linenumber") == k, v) for k, v in forms.items()])
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = dealt(lines, "l_orderkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    return (
        lines.withColumn("sample_idx", at).join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .select(
            problem("l_orderkey").alias("problem"), answer.alias("answer"), F.col("l_quantity").cast("long").alias("q"),
            F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
            "sample_idx", (F.floor(F.col("sample_idx") / 3) + 1).cast("int").alias("round"),
            F.col("p_type").alias("type"), F.concat(F.lit("Level "), (F.col("p_size") % 5 + 1).cast("string")).alias("level"),
        )
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest quantity of each order; every 17th order has no truth."""
    return (
        table(spark, sf_dir, "lineitem").where("l_orderkey % 17 <> 0").groupBy("l_orderkey")
        .agg(F.max(F.col("l_quantity").cast("long")).cast("string").alias("ground_truth"))
        .select(problem("l_orderkey").alias("problem"), "ground_truth")
    )


#: The same in DuckDB, with the final answers written down by form.
SQL = r"""
WITH s AS (
  SELECT 'order ' || l_orderkey AS problem, CAST(l_quantity AS BIGINT) AS q, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS sample_idx,
         p_type AS "type", 'Level ' || (p_size % 5 + 1) AS "level"
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
a AS (
  SELECT *, CAST(sample_idx // 3 + 1 AS INT) AS round,
         CASE line WHEN 4 THEN '100' || q WHEN 5 THEN (2 * q) || '/2' WHEN 6 THEN '' WHEN 7 THEN 'x+' || q ELSE CAST(q AS VARCHAR) END AS fa,
         CASE line WHEN 1 THEN q || ' units' WHEN 2 THEN CAST(q AS VARCHAR) WHEN 4 THEN '100' || q
                   WHEN 5 THEN '\frac{' || (2 * q) || '}{2}' WHEN 7 THEN 'x+' || q ELSE '' END AS fam,
         CASE line WHEN 4 THEN CAST('100' || q AS DOUBLE) WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE q END AS val
  FROM s),
t AS (
  SELECT 'order ' || l_orderkey AS problem, CAST(max(CAST(l_quantity AS BIGINT)) AS VARCHAR) AS ground_truth
  FROM lineitem WHERE l_orderkey % 17 <> 0 GROUP BY l_orderkey),
g AS (
  SELECT a.*, ground_truth, CASE line WHEN 6 THEN 'empty' WHEN 7 THEN 'non_numeric' ELSE 'valid' END AS status,
         coalesce(abs(val - CAST(ground_truth AS DOUBLE)) < 1e-9, false) AS is_correct
  FROM a LEFT JOIN t USING (problem))
"""
