"""Answers of many forms, made from the driver's line items, and SQL that works out what they come to.

``{q}`` stands for the quantity of the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MONTHS, NUMBER
from .fixtures import dealt, table

FORMS = [
    r"<think>try 7</think> So \boxed{{q} \text{ units}}", r"\boxed{\$1,00{q}}", r"\boxed{\frac{2{q}}{2}}", r"\boxed{x+{q}}", r"\boxed{ {q} }", r"\boxed{}",
    r"\boxed{open {{q}", r"\boxed{a{b{c{{q}}}}} then \boxed{9}", r"two: \boxed{{q}} and \boxed{0}", r"\boxed{-{q}/3}", r"\boxed{{q}.50}", r"\boxed{{q}\%}",
    r"\boxed{{q}^\circ}", r"\boxed{{q}^{\circ}}", r"\boxed{1,\!{q}00}", r"\boxed{{q} \, \text{ml}}", r"\boxed{2.\overline{{q}}}", r"\boxed{\dfrac{{q}}{6}}",
    r"\boxed{\frac12}", r"\boxed{\frac{\frac{1}{2}}{{q}}}", r"\boxed{\tfrac{1}{{q}}}", r"\boxed{x^2 + {q}}", r"\boxed{(1,{q})}", r"\boxed{07:30}", r"\boxed{9:{q}0}",
    r"\boxed{00:30}", r"\boxed{\begin{pmatrix}{q}\\2\end{pmatrix}}", r"\boxed{\text{hours}}", r"\boxed{\text{a{b}c} {q}}", r"\boxed{1,2,3,{q}}", r"\boxed{£{q}}",
    r"\boxed{€ {q}}", r"\boxed{$ {q} $}", r"\boxed{{q} m²}", r"\boxed{{q} m^3}", r"\boxed{\text{ }{q}}", "\\boxed{{q}\u00a0\u00a0km}", r"\boxed{  {q}   {q}  }",
    "We get {q}.\n**Answer:** {q} units.", "1,{q}00 and {q}\n**Answer**: 1,{q}00", "**Answer:** {q}", "no {q}\n**Answer:** none", "{q} then 5.\n**Answer:** 5 or {q}",
    "**Final Answer:** {q}.", "**Answer:** June 20th", "**Answer:** Jan {q}", "**Answer:** dec 25th, {q}", "**Answer:** In total {q} on June 20", "**Answer:** 3 apples in May 7",
    "**Answer:** June 2{q}1", "**Answer:** June 20thx", "**Answer:** Sept 3", "**Answer:** {q}/5 of it", "**Answer:** {q}.5/2", "**Answer:** 1,{q}00", "**Answer:** -{q}",
    "**Answer** : {q}", "The total is {q}.", "The total is {q}", "From 1 to {q}. ", "It is 1,234.5 or {q},567.", "and then {q}", "", "a</think> b</think> {q}.", "no numbers.",
    r"\text{x} {q}.", "**Answer:** MARCH 3rd {q}",
]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """form, problem, line, part, supp and answer of every line item."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = dealt(lines, "l_orderkey")
    form = F.expr(f"cast((l_orderkey * 7 + l_linenumber * 3 + l_partkey) % {len(FORMS)} as int)")
    text = F.replace(F.element_at(F.array(*map(F.lit, FORMS)), form + 1), F.lit("{q}"), F.col("l_quantity").cast("long").cast("string"))
    return lines.select(
        form.alias("form"), F.col("l_orderkey").alias("problem"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), text.alias("answer")
    )


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_LIST = ", ".join(_quoted(f).replace("\n", "' || chr(10) || '") for f in FORMS)
_ONE = r"((?:[^{}]|\{[^{}]*\})*)"
_SPACE = r"[\s\x{00a0}]+"


def _replace(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(by)}, 'g')"


def _blocks(x: str, marker: str, keep: bool) -> str:
    """Blocks that nest once at most, then one that is open to the end."""
    mark = marker.replace("\\", "\\\\")
    closed = _replace(x, mark + r"\{" + _ONE + r"\}", r"\1" if keep else "")
    return _replace(closed, mark + r"\{(.*?).?$", r"\1" if keep else "")


def _fraction(x: str, marker: str) -> str:
    mark = marker.replace("\\", "\\\\")
    return _replace(_replace(x, mark + r"([^{])", r"\1"), mark + r"\{" + _ONE + r"\}\{" + _ONE + r"\}", r"\1/\2")


def _cleaned(x: str, math: bool) -> str:
    x = _blocks(_blocks(x, r"\text", math), r"\overline", True)
    if not math:
        x = _fraction(_fraction(x, r"\dfrac"), r"\frac")
        x = _blocks(_blocks(x, r"\begin", False), r"\end", False)
    for gone in ("\\,", "\\!", "\\$", "$", "\\%", "%"):
        x = f"replace({x}, {_quoted(gone)}, '')"
    x = _replace(x, r"\^\{?\\circ\}?", "")
    for gone in ("\\circ", "\\\\", "£", "€"):
        x = f"replace({x}, {_quoted(gone)}, '')"
    if not math:
        x = _replace(_replace(x, r"\^[234]", ""), "[²³]", "")
    # Twice, as a digit between two commas is taken by the first.
    x = _replace(_replace(x, r"(\d),(\d)", r"\1\2"), r"(\d),(\d)", r"\1\2")
    if not math:
        x = f"replace({x}, {_quoted(chr(92))}, '')"
    return f"trim({_replace(x, _SPACE, ' ')})"


_MONTH = rf"(?i)^({'|'.join(MONTHS)})\s+(\d{{1,2}})(?:st|nd|rd|th)?\b"
_VALUE = r"\d+(?:\.\d+)?(?:/\d+(?:\.\d+)?)?"

#: Each step in DuckDB: boxed, fallback, last, math, then fa and fam, the final answers.
SQL = rf"""
WITH x AS (SELECT CAST((l_orderkey * 7 + l_linenumber * 3 + l_partkey) % {len(FORMS)} AS INT) AS form, l_orderkey AS problem, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
    replace(list_value({_LIST})[CAST((l_orderkey * 7 + l_linenumber * 3 + l_partkey) % {len(FORMS)} AS INT) + 1], '{{q}}', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS t FROM lineitem),
  y AS (SELECT *, CASE WHEN contains(t, '\boxed{{') THEN substr(t, instr(t, '\boxed{{') + 7) END AS tail,
    regexp_extract(t, '(?s)^(.*?)\*\*Answer:?\*\*\s*:?\s*(.*)$', 1) AS before, trim(regexp_extract(t, '(?s)^(.*?)\*\*Answer:?\*\*\s*:?\s*(.*)$', 2)) AS after FROM x),
  z AS (SELECT *, coalesce(left(tail, CAST(list_min(list_filter(range(1, length(tail) + 1),
      lambda i: 1 + 2 * i - length(replace(left(tail, CAST(i AS INT)), '{{', '')) - i = length(left(tail, CAST(i AS INT))) - length(replace(left(tail, CAST(i AS INT)), '}}', '')))) - 1 AS INT)), '') AS boxed,
    coalesce(list_filter(regexp_extract_all(before, {_quoted(NUMBER)}), lambda n: list_contains(list_transform(regexp_extract_all(after, {_quoted(NUMBER)}), lambda m: replace(m, ',', '')), replace(n, ',', '')))[-1], '') AS fallback,
    CASE WHEN trim(t) LIKE '%.' THEN coalesce(regexp_extract_all(t, {_quoted(NUMBER)})[-1], '') ELSE '' END AS last,
    CASE WHEN regexp_matches(after, {_quoted(_MONTH)}) THEN upper(left(regexp_extract(after, {_quoted(_MONTH)}, 1), 1)) || lower(substr(regexp_extract(after, {_quoted(_MONTH)}, 1), 2)) || ' ' || regexp_extract(after, {_quoted(_MONTH)}, 2)
      ELSE regexp_replace(regexp_extract(after, {_quoted(_VALUE)}), '^(.*)/(.*)$', '\\frac{{\1}}{{\2}}') END AS math FROM y),
  w AS (SELECT *, CASE WHEN boxed <> '' THEN boxed WHEN fallback <> '' THEN fallback ELSE last END AS raw, CASE WHEN boxed <> '' THEN boxed ELSE math END AS rawm FROM z),
  v AS (SELECT *, {_cleaned('raw', False)} AS c, {_cleaned('rawm', True)} AS fam FROM w),
  u AS (SELECT *, CASE WHEN regexp_matches(c, '^0?(\d{{1,2}}):(\d{{2}})$') THEN CAST(CAST(regexp_extract(c, '^0?(\d{{1,2}}):(\d{{2}})$', 1) AS INT) AS VARCHAR) || regexp_extract(c, ':(\d{{2}})$', 1) ELSE c END AS fa FROM v)
"""
