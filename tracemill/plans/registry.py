"""All queries of the library by name, with DuckDB SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compare as C
from ..functions import text as X
from ..operators import adaptive, assemble, dedup, evaluate, metrics
from ..operators import grade as G
from ..sources import jsonl
from .fixtures import SQL, problem, samples, table, truth
from .forms import SQL as FORMS_SQL
from .forms import answers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SYSTEM = "Solve the problem. Give the answer in a box."
KEY = ("problem", "line", "part", "supp")


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def graded(spark: SparkSession, sf_dir: str, math: bool = False) -> DataFrame:
    return G.grade(samples(spark, sf_dir), truth(spark, sf_dir), math)


COUNTS = """count(*) AS total, count(*) FILTER (status = 'empty') AS "empty", count(*) FILTER (status = 'non_numeric') AS non_numeric,
  count(*) FILTER (status = 'valid') AS "valid", count(*) FILTER (is_correct) AS correct,
  count(*) FILTER (status = 'valid') - count(*) FILTER (is_correct) AS incorrect,
  round(count(*) FILTER (is_correct) * 1.0::DOUBLE / count(*) * 100, 6) AS accuracy,
  CASE WHEN count(*) FILTER (status = 'valid') > 0 THEN round(count(*) FILTER (is_correct) * 1.0::DOUBLE / count(*) FILTER (status = 'valid') * 100, 6) ELSE 0.0::DOUBLE END AS valid_accuracy"""


# Sources -----------------------------------------------------------------------------------------

@query("SELECT 'p ' || o_orderkey AS problem, CAST(o_custkey AS VARCHAR) AS answer FROM orders WHERE o_orderkey % 5 <> 0")
def load_hash_answer(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("p "), F.col("o_orderkey").cast("string")).alias("question"),
        F.when(F.expr("o_orderkey % 5 <> 0"), F.concat(F.lit("so #### 1 and #### "), F.col("o_custkey").cast("string"), F.lit(" \n"))).otherwise("no answer").alias("answer"),
    )
    return jsonl.load_hash(raw)


@query("""SELECT 'p ' || o_orderkey AS problem, CASE o_orderkey % 3 WHEN 0 THEN '\\frac{' || o_custkey || '}{2}' ELSE CAST(o_custkey AS VARCHAR) END AS answer,
  o_orderpriority AS "type", CAST(NULL AS VARCHAR) AS "level" FROM orders WHERE o_orderkey % 5 <> 0""".replace("\\\\", "\\"))
def load_boxed_answer(spark, sf_dir):
    c = F.col("o_custkey").cast("string")
    solution = (
        F.when(F.expr("o_orderkey % 5 = 0"), F.concat(F.lit("open \\boxed{"), c))
        .when(F.expr("o_orderkey % 3 = 0"), F.concat(F.lit("\\boxed{1} then \\boxed{\\frac{"), c, F.lit("}{2}} end")))
        .otherwise(F.concat(F.lit("first \\fbox{ "), c, F.lit("} end")))
    )
    raw = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("p "), F.col("o_orderkey").cast("string")).alias("problem"), solution.alias("solution"),
        F.col("o_orderpriority").alias("type"), F.lit(None).cast("string").alias("level"),
    )
    return jsonl.load_boxed(raw)


# Text --------------------------------------------------------------------------------------------

def _text(name: str, column: Callable, sql: str) -> None:
    @query(SQL + f"SELECT problem, line, part, supp, {sql} AS v FROM a", name)
    def run(spark, sf_dir):
        return samples(spark, sf_dir).select(*KEY, column(F.col("answer")).alias("v"))


_text("extract_boxed", X.extract_boxed, r"""CASE line WHEN 1 THEN q || ' \text{ units}' WHEN 4 THEN '\$1,00' || q
  WHEN 5 THEN '\frac{' || (2 * q) || '}{2}' WHEN 7 THEN 'x+' || q ELSE '' END""")
_text("clean_numeric", lambda a: X.clean(X.extract_boxed(a)), "CASE WHEN line IN (2, 3, 6) THEN '' ELSE fa END")
_text("clean_math", lambda a: X.clean(X.extract_boxed(a), True), "CASE WHEN line IN (2, 3, 6) THEN '' ELSE fam END")
_text("answer_fallback", X.answer_fallback, "CASE line WHEN 2 THEN CAST(q AS VARCHAR) ELSE '' END")
_text("last_number", X.last_number, "CASE WHEN line IN (2, 3) THEN CAST(q AS VARCHAR) ELSE '' END")
_text("math_fallback", X.math_fallback, "CASE line WHEN 2 THEN CAST(q AS VARCHAR) ELSE '' END")
_text("strip_think", lambda a: F.length(X.strip_think(a)), r"""CAST(CASE line WHEN 1 THEN length('So \boxed{' || q || ' \text{ units}}')
  WHEN 2 THEN length('We get .**Answer:**  units.') + 1 + 2 * length(CAST(q AS VARCHAR)) WHEN 3 THEN length('The total is .') + length(CAST(q AS VARCHAR))
  WHEN 4 THEN length('\boxed{\$1,00}') + length(CAST(q AS VARCHAR)) WHEN 5 THEN length('\boxed{\frac{}{2}}') + length(CAST(2 * q AS VARCHAR))
  WHEN 6 THEN length('and then ') + length(CAST(q AS VARCHAR)) ELSE length('\boxed{x+}') + length(CAST(q AS VARCHAR)) END AS INT)""")


@query(SQL + "SELECT problem, line, part, supp, fa AS v FROM a")
def final_answer_numeric(spark, sf_dir):
    return X.with_final_answer(samples(spark, sf_dir), name="v").select(*KEY, "v")


@query(SQL + "SELECT problem, line, part, supp, fam AS v FROM a")
def final_answer_math(spark, sf_dir):
    return X.with_final_answer(samples(spark, sf_dir), name="v", math=True).select(*KEY, "v")


# The same steps over many forms of answers, where SQL works out each of them.

def _form(name: str, columns: dict[str, Callable], sql: dict[str, str]) -> None:
    @query(FORMS_SQL + "SELECT form, problem, line, part, supp, " + ", ".join(f'{v} AS "{k}"' for k, v in sql.items()) + " FROM u", name)
    def run(spark, sf_dir):
        rows = answers(spark, sf_dir)
        return rows.select("form", *KEY, *[f(F.col("answer")).alias(k) for k, f in columns.items()])


_form("forms_extracted", {"boxed": X.extract_boxed, "fallback": X.answer_fallback, "last": X.last_number, "math": X.math_fallback}, {k: k for k in ("boxed", "fallback", "last", "math")})
_form("forms_think", {"left": X.strip_think}, {"left": "trim(CASE WHEN contains(t, '</think>') THEN substr(t, instr(t, '</think>') + 8) ELSE t END)"})
_form("forms_source", {"numeric": X.answer_source, "mathematical": lambda a: X.answer_source(a, True)}, {
    "numeric": "CASE WHEN boxed <> '' THEN 'boxed' WHEN fallback <> '' THEN 'answer' WHEN last <> '' THEN 'last_number' ELSE 'empty' END",
    "mathematical": "CASE WHEN boxed <> '' THEN 'boxed' WHEN math <> '' THEN 'answer' ELSE 'empty' END",
})


@query(FORMS_SQL + "SELECT form, problem, line, part, supp, fa, fam FROM u")
def forms_final(spark, sf_dir):
    both = X.with_final_answer(X.with_final_answer(answers(spark, sf_dir), name="fa"), name="fam", math=True)
    return both.select("form", *KEY, "fa", "fam")


@query(FORMS_SQL + r""", n AS (SELECT *, CASE WHEN regexp_matches(fa, '^-?\d+(\.\d+)?$') THEN 'number' WHEN regexp_matches(fa, '^-?\d+(\.\d+)?/\d+(\.\d+)?$') THEN 'fraction' WHEN fa = '' THEN 'empty' ELSE 'other' END AS kind FROM u)
  SELECT form, kind, count(*) AS n, round(sum(CASE kind WHEN 'number' THEN CAST(fa AS DOUBLE) WHEN 'fraction' THEN CAST(split_part(fa, '/', 1) AS DOUBLE) / nullif(CAST(split_part(fa, '/', 2) AS DOUBLE), 0) END), 4) AS total FROM n GROUP BY form, kind""")
def forms_values(spark, sf_dir):
    rows = X.with_final_answer(answers(spark, sf_dir), name="fa").withColumn("kind", C.number_kind(F.col("fa")))
    value = F.when(F.col("kind").isin("number", "fraction"), C.number_value(F.col("fa")))
    return rows.groupBy("form", "kind").agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))


@query(SQL + "SELECT CASE line WHEN 2 THEN 'answer' WHEN 3 THEN 'last_number' WHEN 6 THEN 'empty' ELSE 'boxed' END AS source, count(*) AS n FROM a GROUP BY 1")
def extraction_provenance(spark, sf_dir):
    return samples(spark, sf_dir).groupBy(X.answer_source(F.col("answer")).alias("source")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, len(list_filter(range(4, 81), lambda n: length(text) >= 8 * n
  AND right(text, CAST(8 * n AS INT)) = repeat(left(right(text, CAST(8 * n AS INT)), CAST(n AS INT)), 8))) > 0 AS repeats FROM documents""")
def repetition_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.repeats_at_end(F.col("text")).alias("repeats"))


# Grading -----------------------------------------------------------------------------------------

@query(SQL + "SELECT problem, line, part, supp, fa AS final_answer FROM a WHERE line IN (6, 7)")
def bad_rows(spark, sf_dir):
    return G.bad_rows(X.with_final_answer(samples(spark, sf_dir))).select(*KEY, "final_answer")


@query(SQL + "SELECT problem, line, part, supp, fa AS final_answer, ground_truth, status, is_correct FROM g")
def grade_samples(spark, sf_dir):
    return graded(spark, sf_dir).select(*KEY, "final_answer", "ground_truth", "status", "is_correct")


@query(SQL + "SELECT problem, line, part, supp, fam AS final_answer, coalesce(fam <> '' AND fam = ground_truth, false) AS is_correct FROM g")
def grade_samples_math(spark, sf_dir):
    return graded(spark, sf_dir, True).select(*KEY, "final_answer", "is_correct")


@query(SQL + f"SELECT {COUNTS} FROM g")
def grade_summary(spark, sf_dir):
    return metrics.summary(graded(spark, sf_dir))


@query(SQL + f'SELECT "type", {COUNTS} FROM g GROUP BY "type"')
def grade_by_type(spark, sf_dir):
    return metrics.summary(graded(spark, sf_dir), "type")


@query(SQL + f'SELECT "level", {COUNTS} FROM g GROUP BY "level"')
def grade_by_level(spark, sf_dir):
    return metrics.summary(graded(spark, sf_dir), "level")


@query(SQL + f"SELECT round, {COUNTS} FROM g GROUP BY round")
def grade_by_round(spark, sf_dir):
    return metrics.summary(graded(spark, sf_dir), "round")


@query(SQL + f"""SELECT 'all' AS kind, '' AS name, {COUNTS} FROM g
  UNION ALL SELECT 'type', "type", {COUNTS} FROM g WHERE "type" IS NOT NULL GROUP BY "type"
  UNION ALL SELECT 'level', "level", {COUNTS} FROM g WHERE "level" IS NOT NULL GROUP BY "level" """)
def category_report(spark, sf_dir):
    return metrics.category_report(graded(spark, sf_dir))


@query(SQL + """, p AS (SELECT problem, bool_and(is_correct) AS every, bool_or(is_correct) AS anyone, max(ground_truth) IS NOT NULL AS known, count(*) AS n FROM g GROUP BY problem)
  SELECT count(*) AS problems, count(*) FILTER (known) AS with_truth, count(*) FILTER (known AND every) AS all_correct,
  count(*) FILTER (known AND anyone) AS any_correct, count(*) FILTER (known AND NOT anyone) AS none_correct,
  round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS avg_samples FROM p""")
def problem_level(spark, sf_dir):
    return metrics.problem_level(graded(spark, sf_dir))


@query(SQL + "SELECT DISTINCT problem FROM a WHERE problem NOT IN (SELECT problem FROM t)")
def missing_truth(spark, sf_dir):
    return G.missing_truth(graded(spark, sf_dir))


@query(SQL + 'SELECT problem, line, part, supp, fa AS final_answer, ground_truth, "type", "level" FROM g WHERE is_correct')
def correct_rows(spark, sf_dir):
    return G.correct_rows(graded(spark, sf_dir)).select(*KEY, "final_answer", "ground_truth", "type", "level")


@query(SQL + "SELECT problem, line, part, supp, fa AS final_answer, ground_truth FROM g WHERE NOT is_correct AND status = 'valid' AND ground_truth IS NOT NULL")
def incorrect_rows(spark, sf_dir):
    return G.incorrect_rows(graded(spark, sf_dir)).select(*KEY, "final_answer", "ground_truth")


@query(SQL + "SELECT problem, line, part, supp, fa AS final_answer, ground_truth FROM g WHERE NOT is_correct AND status <> 'empty'")
def incorrect_rows_adaptive(spark, sf_dir):
    return G.incorrect_rows(graded(spark, sf_dir), adaptive=True).select(*KEY, "final_answer", "ground_truth")


@query(SQL + """SELECT status, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM
  (SELECT CASE WHEN status = 'valid' THEN CASE WHEN is_correct THEN 'correct' ELSE 'wrong' END ELSE status END AS status FROM g) GROUP BY status""")
def error_taxonomy(spark, sf_dir):
    g = graded(spark, sf_dir)
    kind = F.when(F.col("status") != "valid", F.col("status")).when(F.col("is_correct"), "correct").otherwise("wrong")
    counts = g.groupBy(kind.alias("status")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("status", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("share"))


@query(SQL + ", c AS (SELECT problem, count(*) AS size FROM a GROUP BY problem) SELECT size, count(*) AS groups FROM c GROUP BY size")
def group_size_histogram(spark, sf_dir):
    return metrics.group_sizes(samples(spark, sf_dir), "problem")


@query(SQL + """SELECT problem FROM g WHERE round = 1 GROUP BY problem HAVING NOT bool_or(is_correct)
  AND problem IN (SELECT problem FROM g WHERE round > 1 AND is_correct)""")
def error_correction_set(spark, sf_dir):
    g = graded(spark, sf_dir)
    return G.error_correction_set(g.where("round = 1"), g.where("round > 1"))


@query(SQL + """, p AS (SELECT round, problem, bool_or(is_correct) AS covered, count(*) AS n FROM g GROUP BY ALL)
  SELECT round, count(*) AS problems, count(*) FILTER (covered) AS covered, round(count(*) FILTER (covered) * 1.0::DOUBLE / count(*) * 100, 6) AS coverage,
  round(CAST(sum(n) AS DOUBLE) / nullif(count(*) FILTER (covered), 0), 6) AS samples_per_covered FROM p GROUP BY round""")
def coverage(spark, sf_dir):
    return metrics.coverage(graded(spark, sf_dir), "round")


_MODELS = [f"line {k}" for k in range(1, 8)]
_ACCURACY = "round(count(*) FILTER (line = {k} AND is_correct) * 1.0::DOUBLE / nullif(count(*) FILTER (line = {k}), 0) * 100, 6)"


# Of equal models the last in order of name is the best.
@query(SQL + ', r AS (SELECT "type", ' + ", ".join(f'{_ACCURACY.format(k=k)} AS "line {k}"' for k in range(1, 8)) + ' FROM g GROUP BY "type") SELECT *, CASE greatest('
  + ", ".join(f'coalesce("line {k}", -1)' for k in range(1, 8)) + ") " + " ".join(f"WHEN coalesce(\"line {k}\", -1) THEN 'line {k}'" for k in range(7, 0, -1)) + " END AS best FROM r")
def model_pivot(spark, sf_dir):
    g = graded(spark, sf_dir).withColumn("model", F.concat(F.lit("line "), F.col("line").cast("string")))
    return metrics.model_pivot(g, _MODELS)


@query(SQL + f""", m AS (SELECT 'line ' || line AS model, {COUNTS} FROM g GROUP BY line)
  SELECT model, accuracy, round(accuracy - (SELECT accuracy FROM m WHERE model = 'line 1'), 6) AS delta FROM m""")
def baseline_delta(spark, sf_dir):
    g = graded(spark, sf_dir).withColumn("model", F.concat(F.lit("line "), F.col("line").cast("string")))
    return metrics.baseline_delta(metrics.summary(g, "model").select("model", "accuracy"), "line 1")


# Deduplication -----------------------------------------------------------------------------------

_VEC = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_KEPT = """, grp AS (SELECT k, list({{'id': vec_id, 'v': v}} ORDER BY vec_id) AS xs FROM (SELECT *, {key} AS k FROM e) GROUP BY k),
  kept AS (SELECT k, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x:
    CASE WHEN len(list_filter(acc, lambda y: list_dot_product(y.v, x[1].v) > {least})) > 0 THEN acc ELSE list_concat(acc, x) END)).id AS vec_id FROM grp)"""
#: A problem has up to six samples, of the files ``even`` and ``odd``; every 11th sample is its problem's only one.
_PROBLEM = "CASE WHEN vec_id % 11 = 0 THEN -vec_id ELSE vec_id // 12 END"
_GREEDY = _VEC + _KEPT.format(key=f"{{'file': CASE vec_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END, 'problem': {_PROBLEM}}}", least=0.1)


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.when(F.expr("vec_id % 2 = 0"), "even").otherwise("odd")
    return table(spark, sf_dir, "embeddings").withColumns({"file": file, "problem": F.expr(_PROBLEM.replace("//", "div"))})


def _kept(rows: DataFrame) -> DataFrame:
    return dedup.greedy_dedup(rows, ("file", "problem"), "vec_id", "embedding", 0.1)


@query(_GREEDY + "SELECT k.file AS file, k.problem AS problem, vec_id FROM kept")
def greedy_dedup(spark, sf_dir):
    return _kept(_sampled(spark, sf_dir)).select("file", "problem", "vec_id")


@query(_VEC + _KEPT.format(key="label", least=0.3) + "SELECT k AS label, vec_id FROM kept")
def greedy_dedup_large(spark, sf_dir):
    return dedup.greedy_dedup(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.3)


_STATS = """, b AS (SELECT CASE vec_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS file, """ + _PROBLEM + """ AS problem, count(*) AS n FROM e GROUP BY ALL),
  f AS (SELECT k.file AS file, k.problem AS problem, count(*) AS m FROM kept GROUP BY ALL), s AS (SELECT b.*, coalesce(m, 0) AS m FROM b LEFT JOIN f USING (file, problem))
  SELECT {file}count(*) AS problems, CAST(sum(n) AS BIGINT) AS before, CAST(sum(m) AS BIGINT) AS after, CAST(sum(n) - sum(m) AS BIGINT) AS discarded,
  round(CAST(sum(m) AS DOUBLE) / sum(n) * 100, 6) AS retention, count(*) FILTER (n = 1) AS one, count(*) FILTER (n = 2) AS two, count(*) FILTER (n >= 3) AS more,
  CAST(sum(n - 1) AS BIGINT) AS pairs_total, CAST(sum(n) - sum(m) AS BIGINT) AS pairs_above FROM s{group}"""


@query(_GREEDY + _STATS.format(file="", group=""))
def dedup_stats(spark, sf_dir):
    rows = _sampled(spark, sf_dir)
    return dedup.dedup_stats(rows, _kept(rows), "file", "problem")


@query(_GREEDY + _STATS.format(file="file, ", group=" GROUP BY ROLLUP (file)"))
def dedup_stats_by_file(spark, sf_dir):
    rows = _sampled(spark, sf_dir)
    return dedup.dedup_stats(rows, _kept(rows), "file", "problem", by="file")


_POSITIONS = _VEC + """, x AS (SELECT row_number() OVER (ORDER BY vec_id) AS pos, vec_id, v FROM e WHERE label < 5),
  y AS (SELECT row_number() OVER (ORDER BY vec_id) AS pos, vec_id, v FROM e WHERE label >= 5)"""


@query(_POSITIONS + """SELECT CAST(pos AS INT) AS pos, 0 AS side, vec_id FROM x UNION ALL
  SELECT CAST(y.pos AS INT), 1, y.vec_id FROM y LEFT JOIN x USING (pos) WHERE x.v IS NULL OR list_dot_product(x.v, y.v) <= 0.05""")
def pairwise_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return dedup.pairwise_dedup(e.where("label < 5"), e.where("label >= 5"), "vec_id", "embedding", 0.05)


def _pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pairs = dedup.positional_pairs(e.where("label < 5"), e.where("label >= 5"), "vec_id").where("a is not null and b is not null")
    return pairs.select(dedup.dot(F.col("a.embedding"), F.col("b.embedding")).alias("sim"))


_SIMS = _POSITIONS + ", p AS (SELECT list_dot_product(x.v, y.v) AS sim FROM x JOIN y USING (pos)) "


@query(_SIMS + "SELECT count(*) AS n, round(min(sim), 6) AS low, round(max(sim), 6) AS high, round(avg(sim), 6) AS mean, round(median(sim), 6) AS mid, round(stddev_pop(sim), 6) AS std FROM p")
def similarity_stats(spark, sf_dir):
    return metrics.similarity_stats(_pairs(spark, sf_dir))


@query(_SIMS + """, b AS (SELECT unnest([0.0, 0.5, 0.7, 0.8, 0.85, 0.9, 0.92, 0.95, 0.97, 0.98, 0.99])::DOUBLE AS lo, unnest([0.5, 0.7, 0.8, 0.85, 0.9, 0.92, 0.95, 0.97, 0.98, 0.99, 1.0])::DOUBLE AS hi)
  SELECT lo, hi, count(sim) AS n FROM b LEFT JOIN p ON sim >= lo AND sim < hi GROUP BY lo, hi""")
def similarity_histogram(spark, sf_dir):
    return metrics.similarity_histogram(_pairs(spark, sf_dir))


@query("SELECT role AS file, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(length(text)), 6) AS mean_chars FROM conversations GROUP BY role")
def answer_lengths(spark, sf_dir):
    return metrics.length_stats(table(spark, sf_dir, "conversations"), "role", "text").withColumnRenamed("role", "file")


@query("""WITH c AS (SELECT conv_id, "turn", list_concat(list_transform(['a', 'e', 'i', 'o', 'u'], lambda c: CAST(length(text) - length(replace(text, c, '')) AS DOUBLE)), [1.0::DOUBLE]) AS v FROM conversations)
  SELECT conv_id, "turn", round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(list_sum(v) / sqrt(list_dot_product(v, v)), 6) AS total FROM c""")
def embed_texts(spark, sf_dir):
    def letter_counts(texts: list[str]) -> np.ndarray:
        """How often a text has each vowel, and one."""
        return np.array([[*(t.count(c) for c in "aeiou"), 1.0] for t in texts]).reshape(-1, 6)

    made = dedup.embed(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), letter_counts, "text")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v)
    return made.select("conv_id", "turn", F.round(F.col("embedding")[0], 6).alias("first"), F.round(total, 6).alias("total"))


# Groups of three vectors, as a problem has three samples.
@query(_VEC + """, p AS (SELECT i.vec_id // 3 AS g, list_dot_product(i.v, j.v) AS sim FROM e i JOIN e j ON i.vec_id // 3 = j.vec_id // 3 AND i.vec_id < j.vec_id),
  q AS (SELECT g, count(*) AS n, sum(sim) AS s, count(*) FILTER (sim >= 0.1) AS o FROM p GROUP BY g)
  SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS pairs, round(sum(s) / sum(n), 6) AS mean_sim, round(CAST(sum(o) AS DOUBLE) / sum(n) * 100, 6) AS pairs_over_pct,
  round(count(*) FILTER (o = n) * 1.0::DOUBLE / count(*) * 100, 6) AS groups_over_pct FROM q""")
def redundancy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("g", F.expr("vec_id div 3"))
    return dedup.redundancy(e, "g", "vec_id", "embedding", 0.1)


# Assembly ----------------------------------------------------------------------------------------

@query("""SELECT 'c ' || c_custkey AS problem, c_mktsegment AS answer, CAST(NULL AS VARCHAR) AS "type" FROM customer
  UNION ALL SELECT 'p ' || p_partkey, p_name, p_type FROM part""")
def merge_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.concat(F.lit("c "), F.col("c_custkey").cast("string")).alias("problem"), F.col("c_mktsegment").alias("answer"))
    b = table(spark, sf_dir, "part").select(F.concat(F.lit("p "), F.col("p_partkey").cast("string")).alias("problem"), F.col("p_name").alias("answer"), F.col("p_type").alias("type"))
    return assemble.merge(a, b)


@query("SELECT o_orderkey, md5('42:' || o_orderkey) AS h FROM orders ORDER BY 2, 1")
def shuffle_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", assemble.shuffle_key("o_orderkey").alias("h"))
    return assemble.shuffle(o, "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) <= floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'test' END AS part FROM orders""")
def train_test_split(spark, sf_dir):
    return assemble.split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) <= floor(count(*) OVER () * 0.95) THEN 'train' ELSE 'test' END AS part FROM orders""")
def train_eval_split(spark, sf_dir):
    return assemble.split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.95, 7)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def prefix_limit(spark, sf_dir):
    return assemble.prefix(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100)


@query(f"""SELECT conv_id, "turn", 'system' AS role1, '{SYSTEM}' AS content1, 'user' AS role2, 'Problem: ' || "text" AS content2, 'assistant' AS role3, 'Answer: ' || "text" AS content3
  FROM conversations WHERE role = 'user'""")
def sft_rows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    m = c.select("conv_id", "turn", assemble.sft_messages(F.col("text"), F.concat(F.lit("Answer: "), F.col("text")), SYSTEM).alias("m"))
    return m.select("conv_id", "turn", *[F.col("m")[i][f].alias(f"{f}{i + 1}") for i in range(3) for f in ("role", "content")])


# Sampling ----------------------------------------------------------------------------------------

@query("""WITH s AS (SELECT user_id, event_id // 3 AS s, avg(-value / 100) AS m FROM events GROUP BY ALL),
  u AS (SELECT user_id, coalesce(max(m) >= -0.2, false) AS ok, count(*) AS n FROM s GROUP BY user_id)
  SELECT ok, count(*) AS users, CAST(sum(n) AS BIGINT) AS samples FROM u GROUP BY ok""")
def logprob_confidence(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id", F.expr("event_id div 3").alias("s")).agg(F.avg(-F.col("value") / 100).alias("m"))
    users = s.groupBy("user_id").agg(F.coalesce(F.max("m") >= -0.2, F.lit(False)).alias("ok"), F.count("*").alias("n"))
    return users.groupBy("ok").agg(F.count("*").alias("users"), F.sum("n").alias("samples"))


def fake_provider(todo: DataFrame, temperature: float, n: int, turn: int) -> DataFrame:
    """Problems ``order k`` are confident in round k % 7; those of 0 or above 5 never."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = batch.loc[batch.index.repeat(n), ["problem"]].reset_index(drop=True)
            made["sample_idx"] = [i % n for i in range(len(made))]
            made["answer"] = [f"<think>first</think> {p} at {turn} " for p in made["problem"]]
            sure = made["problem"].str.split(" ").str[-1].astype("int64") % 7 == turn
            made["token_logprobs"] = [[-1.0, -2.0] if s else [-3.0, None] for s in sure]
            yield made[["problem", "answer", "sample_idx", "token_logprobs"]]

    return todo.mapInPandas(run, adaptive.SAMPLE)


@query("""WITH p AS (SELECT 'order ' || o_orderkey AS problem, o_orderkey % 7 AS k FROM orders),
  r AS (SELECT problem, unnest(range(1, CASE WHEN k BETWEEN 1 AND 5 THEN k ELSE 5 END + 1)) AS round FROM p)
  SELECT CAST(round AS INT) AS round, CASE round WHEN 1 THEN 0.3::DOUBLE ELSE 0.9::DOUBLE END AS temperature,
  CAST(sum(CASE round WHEN 1 THEN 3 ELSE 2 END) AS BIGINT) AS samples, count(DISTINCT problem) AS problems FROM r GROUP BY round""")
def adaptive_rounds(spark, sf_dir):
    made = _adaptive(spark, sf_dir)
    return made.groupBy("round", "temperature").agg(F.count("*").alias("samples"), F.countDistinct("problem").alias("problems"))


def _adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .checkpoints import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    problems = table(spark, sf_dir, "orders").select(problem("o_orderkey").alias("problem"))
    return adaptive.adaptive_sample(problems, fake_provider)


@query("""WITH p AS (SELECT 'order ' || o_orderkey AS problem, o_orderkey % 7 AS k FROM orders),
  r AS (SELECT problem, unnest(range(1, CASE WHEN k BETWEEN 1 AND 5 THEN k ELSE 5 END + 1)) AS round FROM p)
  SELECT problem || ' at ' || round AS answer, count(*) * CASE WHEN round = 1 THEN 3 ELSE 2 END AS n FROM r GROUP BY problem, round""")
def adaptive_answers(spark, sf_dir):
    return _adaptive(spark, sf_dir).groupBy("answer").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT o_orderkey % 7 AS k FROM orders), r AS (SELECT k, unnest(range(1, CASE WHEN k BETWEEN 1 AND 5 THEN k ELSE 5 END + 1)) AS round FROM p),
  c AS (SELECT CAST(round AS INT) AS round, count(*) AS problems, count(*) FILTER (k = round) AS high FROM r GROUP BY round)
  SELECT *, problems - high AS low, round(high * 100.0::DOUBLE / problems, 6) AS high_pct, round((problems - high) * 100.0::DOUBLE / problems, 6) AS low_pct FROM c""")
def confidence_rounds(spark, sf_dir):
    return adaptive.confidence_by_round(_adaptive(spark, sf_dir))


# Evaluation --------------------------------------------------------------------------------------

def fake_model(problems: DataFrame, settings: evaluate.Settings) -> DataFrame:
    """Right where the truth is no multiple of 3, wrong or without an answer otherwise."""
    k = F.col("answer").cast("long")
    text = (
        F.when(k % 3 > 0, F.concat(F.lit("<think>hm</think> \\boxed{"), F.col("answer"), F.lit("}")))
        .when(k % 2 > 0, "\\boxed{-1}").otherwise("I do not know")
    )
    return problems.withColumn("generated", text)


@query("""WITH o AS (SELECT CASE o_orderkey % 2 WHEN 0 THEN 'gsm8k' ELSE 'math' END AS dataset, o_custkey AS k FROM orders),
  c AS (SELECT dataset, count(*) AS total, count(*) FILTER (k % 3 = 0 AND k % 2 = 0) AS "empty", count(*) FILTER (k % 3 > 0) AS correct FROM o GROUP BY dataset)
  SELECT *, round(correct * 100.0::DOUBLE / total, 6) AS accuracy, total - "empty" AS "valid", round(correct * 100.0::DOUBLE / (total - "empty"), 6) AS valid_accuracy FROM c""")
def baseline_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey % 2").alias("k"), problem("o_orderkey").alias("problem"), F.col("o_custkey").cast("string").alias("answer"),
        F.lit("t").alias("type"), F.lit("l").alias("level"),
    )
    sets = {"gsm8k": (o.where("k = 0"), False), "math": (o.where("k = 1"), True)}
    made = [evaluate.predict(rows, fake_model, evaluate.BASELINE, math=math).withColumn("dataset", F.lit(name)) for name, (rows, math) in sets.items()]
    return metrics.summary(assemble.merge(*made), "dataset").drop("non_numeric", "incorrect")


@query(SQL + "SELECT problem, line, part, supp FROM a WHERE fa = ''")
def empty_rows(spark, sf_dir):
    return G.empty_rows(X.with_final_answer(samples(spark, sf_dir))).select(*KEY)


@query("SELECT conv_id, \"turn\", text || '.' AS text FROM conversations")
def trailing_period(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.with_period(F.col("text")).alias("text"))


@query("""WITH d AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents)
  SELECT count(*) AS total, count(*) FILTER (n >= 400) AS over_limit, count(*) FILTER (n < 400) AS under_limit,
  round(count(*) FILTER (n >= 400) * 1.0::DOUBLE / count(*) * 100, 6) AS over_pct, (SELECT list(doc_id ORDER BY doc_id) FROM (SELECT doc_id FROM d WHERE n >= 400 ORDER BY doc_id LIMIT 10)) AS first_over FROM d""")
def token_limit(spark, sf_dir):
    return metrics.token_limit(table(spark, sf_dir, "documents"), F.size(F.split("text", " ")), 400, "doc_id")


# Quality -----------------------------------------------------------------------------------------

#: What is put behind the documents, which hold none of it themselves.
_NOTES = ["", " wait", " Oops", " Actually,", " Hmm I made a mistake", " \\boxed{1}", " $$x", " $$x$$", " [a", " [a]", "\nsame\n same\nsame \nsame"]
_NOTED = "(SELECT doc_id, lang, coalesce(text, '') || list_value(" + ", ".join("'" + n.replace("\n", "' || chr(10) || '") + "'" for n in _NOTES) + f")[CAST(doc_id % {len(_NOTES)} AS INT) + 1] AS text FROM documents)"


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.element_at(F.array(*map(F.lit, _NOTES)), (F.col("doc_id") % len(_NOTES)).cast("int") + 1)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.coalesce("text", F.lit("")), note).alias("text"))


_FLAGS = r"""f AS (SELECT doc_id, lang, text,
  contains(text, 'wait') OR contains(text, 'Oops') OR contains(text, 'Actually,') OR contains(text, 'Hmm') OR contains(text, 'I made a mistake') AS self_correction,
  coalesce(doc_id IN (SELECT doc_id FROM l WHERE line <> '' GROUP BY doc_id, line HAVING count(*) >= 4), false) AS repeated_lines,
  NOT contains(text, '\boxed{') AS no_boxed, length(text) < 200 OR length(text) > 3000 AS extreme_length,
  (length(text) - length(replace(text, '$$', ''))) / 2 % 2 = 1 OR length(replace(text, '[', '')) <> length(replace(text, ']', '')) AS artifacts FROM noted)"""
_LINES = f"WITH noted AS {_NOTED}, l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM noted), "


@query(_LINES + _FLAGS + "SELECT doc_id, self_correction, repeated_lines, no_boxed, extreme_length, artifacts FROM f")
def quality_flags(spark, sf_dir):
    return metrics.quality_flags(noted(spark, sf_dir)).select("doc_id", *metrics.FLAGS)


@query(_LINES + _FLAGS + "SELECT lang, count(*) AS total, " + ", ".join(
    f"count(*) FILTER ({f}) AS {f}, round(count(*) FILTER ({f}) * 1.0::DOUBLE / count(*) * 100, 6) AS {f}_pct" for f in metrics.FLAGS
) + ", round(avg(length(text)), 6) AS mean_chars FROM f GROUP BY lang")
def quality_table(spark, sf_dir):
    return metrics.quality_table(metrics.quality_flags(noted(spark, sf_dir)), "lang")


@query(_LINES + _FLAGS + "SELECT doc_id FROM f WHERE NOT self_correction AND NOT repeated_lines")
def quality_filter(spark, sf_dir):
    return metrics.quality_flags(noted(spark, sf_dir)).where("not self_correction and not repeated_lines").select("doc_id")
