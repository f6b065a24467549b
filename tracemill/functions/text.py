"""Answer extraction and cleaning as column expressions.

Balanced braces are folded over the characters of a text.  On texts that nest at
most three deep, which is nearly all, a regular expression anchored behind the
marker finds the same content without the fold.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
ANSWER = r"\*\*Answer:?\*\*\s*:?\s*"
#: The month names that an answer may give, in full or short.
MONTHS = (
    "January February March April May June July August September October November December "
    "Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec"
).split()
_FLAT = r"[^{}]*+"
_DEEP = rf"(?:[^{{}}]++|\{{(?:[^{{}}]++|\{{(?:[^{{}}]++|\{{{_FLAT}\}})*+\}})*+\}})*+"
#: Stands for a marker while a text is folded (a private-use character).
_MARK = "\ue000"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``x``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def strip(x: Column) -> Column:
    """Trim every kind of white space."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def _closing(tail: Column, depth: int) -> Column:
    """Place (from 1) of the brace in ``tail`` that brings ``depth`` back to 0; 0 if none."""
    start = F.struct(F.lit(depth).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        at = s["at"] + 1
        end = F.when((s["end"] == 0) & (c == "}") & (depth == 0), at).otherwise(s["end"])
        return F.struct(depth.alias("depth"), at.alias("at"), end.alias("end"))

    return F.aggregate(F.split(tail, ""), start, step, lambda s: s["end"])


def extract_boxed(text: Column) -> Column:
    """Content of the first ``\\boxed{``, '' if absent, empty or unbalanced."""
    tail = F.substring(text, F.instr(text, "\\boxed{") + 7, F.length(text))
    quick = rf"^({_DEEP})\}}"

    def inside(tail: Column) -> Column:
        slow = F.substring(tail, F.lit(1), F.greatest(_closing(tail, 1) - 1, F.lit(0)))
        return F.when(F.rlike(tail, F.lit(quick)), F.regexp_extract(tail, quick, 1)).otherwise(slow)

    return F.when(F.contains(text, F.lit("\\boxed{")), let(tail, inside)).otherwise("")


def hash_answer(raw: Column) -> Column:
    """What follows the last ``####``; null if there is none."""
    return F.when(F.contains(raw, F.lit("####")), strip(F.substring_index(raw, "####", -1)))


def last_boxed(text: Column) -> Column:
    """From the last ``\\boxed``, else the last ``\\fbox``, to its closing brace; null if none."""

    def since(marker: str) -> Column:
        return F.substring_index(text, marker, -1)

    marker = F.when(F.contains(text, F.lit("\\boxed")), "\\boxed").when(F.contains(text, F.lit("\\fbox")), "\\fbox")
    tail = F.when(marker == "\\boxed", since("\\boxed")).otherwise(since("\\fbox"))
    end = _closing(tail, 0)
    return F.when(marker.isNotNull() & (end > 0), F.concat(marker, F.substring(tail, F.lit(1), end)))


def last_boxed_content(text: Column) -> Column:
    """Between the first and the last brace of :func:`last_boxed`, trimmed."""
    found = last_boxed(text)
    return strip(F.regexp_extract(found, r"(?s)\{(.*)\}", 1))


def _flat(x: Column, marker: str, blocks: int) -> tuple[Column, str]:
    """Whether ``blocks`` blocks without inner braces follow every ``marker``, and the pattern of one with them."""
    one = r"\{([^{}]*)\}"
    mark, rest = re.escape(marker.rstrip("{")), one * blocks
    return ~F.rlike(x, F.lit(f"{mark}(?!{rest})" if blocks > 1 else f"{mark}\\{{(?![^{{}}]*\\}})")), mark + rest


def remove_blocks(text: Column, marker: str, keep: bool = False) -> Column:
    """Without the balanced blocks that ``marker`` opens; ``keep`` leaves what is
    in them.  An open block goes to the end; kept, it loses its last character (E4).

    Blocks without inner braces go by a pattern, others by a fold."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"), F.lit("").alias("inside"))

    def step(s: Column, c: Column) -> Column:
        outside = s["depth"] == 0
        depth = s["depth"] + F.when(c.isin(_MARK, "{"), 1).when(c == "}", -1).otherwise(0)
        shown = F.when(c == _MARK, marker).otherwise(c)
        closes = ~outside & (depth == 0)
        return F.struct(
            F.when(outside, F.when(c == _MARK, 1).otherwise(0)).otherwise(depth).alias("depth"),
            F.when(outside & (c != _MARK), F.concat(s["out"], c))
            .when(closes & F.lit(keep), F.concat(s["out"], s["inside"])).otherwise(s["out"]).alias("out"),
            F.when(outside | closes, "").otherwise(F.concat(s["inside"], shown)).alias("inside"),
        )

    def finish(s: Column) -> Column:
        rest = F.substring(s["inside"], F.lit(1), F.greatest(F.length(s["inside"]) - 1, F.lit(0)))
        return F.concat(s["out"], rest) if keep else s["out"]

    def folded(x: Column) -> Column:
        chars = F.split(F.replace(x, F.lit(marker), F.lit(_MARK)), "")
        flat, block = _flat(x, marker, 1)
        fast = F.when(flat, F.regexp_replace(x, block, "$1" if keep else ""))
        return F.when(F.contains(x, F.lit(marker)), fast.otherwise(F.aggregate(chars, start, step, finish))).otherwise(x)

    return folded(text)


def fractions(text: Column, marker: str) -> Column:
    """``marker{a}{b}`` as a/b; without a denominator ``{a}`` stays, without braces the rest (E5)."""
    start = F.struct(
        F.lit("plain").alias("mode"), F.lit(0).alias("depth"), F.lit("").alias("out"), F.lit("").alias("top"), F.lit("").alias("under")
    )

    def step(s: Column, c: Column) -> Column:
        mode, mark = s["mode"], c == _MARK
        shown = F.when(mark, marker).otherwise(c)
        inside = mode.isin("top", "under")
        depth = F.when(inside, s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).otherwise(1)
        closes = inside & (depth == 0)
        lone = F.when(mode == "between", F.concat(F.lit("{"), s["top"], F.lit("}"))).otherwise("")
        opens = mode.isin("marked", "between") & (c == "{")
        ends = (mode == "under") & closes
        return F.struct(
            F.when(opens, F.when(mode == "marked", "top").otherwise("under"))
            .when((mode == "top") & closes, "between").when(inside & ~closes, mode)
            .when(mark & (mode != "marked"), "marked").otherwise("plain").alias("mode"),
            depth.alias("depth"),
            F.when(opens | (inside & ~ends), s["out"])
            .when(ends, F.concat(s["out"], s["top"], F.lit("/"), s["under"]))
            .when(mark & (mode != "marked"), F.concat(s["out"], lone))
            .otherwise(F.concat(s["out"], lone, shown)).alias("out"),
            F.when(opens & (mode == "marked"), "").when((mode == "top") & ~closes, F.concat(s["top"], shown)).otherwise(s["top"]).alias("top"),
            F.when(opens & (mode == "between"), "").when((mode == "under") & ~closes, F.concat(s["under"], shown)).otherwise(s["under"]).alias("under"),
        )

    def finish(s: Column) -> Column:
        cut = F.substring(s["under"], F.lit(1), F.greatest(F.length(s["under"]) - 1, F.lit(0)))
        return F.concat(
            s["out"],
            F.when(s["mode"] == "top", F.concat(F.lit("{"), s["top"]))
            .when(s["mode"] == "between", F.concat(F.lit("{"), s["top"], F.lit("}")))
            .when(s["mode"] == "under", F.concat(s["top"], F.lit("/"), cut)).otherwise(""),
        )

    def folded(x: Column) -> Column:
        chars = F.split(F.replace(x, F.lit(marker), F.lit(_MARK)), "")
        flat, block = _flat(x, marker, 2)
        fast = F.when(flat, F.regexp_replace(x, block, "$1/$2"))
        return F.when(F.contains(x, F.lit(marker)), fast.otherwise(F.aggregate(chars, start, step, finish))).otherwise(x)

    return folded(text)


def numbers(text: Column) -> Column:
    """All numbers in ``text``, without sign."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def plain_number(x: Column) -> Column:
    """Without commas."""
    return F.replace(x, F.lit(","), F.lit(""))


def _around_answer(text: Column) -> tuple[Column, Column]:
    """What stands before and after the first answer marker."""
    parts = F.split(text, ANSWER, 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def answer_fallback(text: Column) -> Column:
    """The latest number before the answer marker that the answer also has."""
    before, after = _around_answer(text)
    given = F.transform(numbers(after), plain_number)
    found = F.filter(F.reverse(numbers(before)), lambda x: F.array_contains(given, plain_number(x)))
    return F.when(F.rlike(text, F.lit(ANSWER)), F.coalesce(F.get(found, F.lit(0)), F.lit(""))).otherwise("")


def last_number(text: Column) -> Column:
    """The last number of a text that ends with a period."""
    found = F.coalesce(F.try_element_at(numbers(text), F.lit(-1)), F.lit(""))
    return F.when(F.endswith(strip(text), F.lit(".")), found).otherwise("")


def math_fallback(text: Column) -> Column:
    """After the answer marker: the month and day it starts with, else the first number or fraction."""
    _, after = _around_answer(text)
    after = strip(after)
    date = rf"(?i)^({'|'.join(MONTHS)})\s+(\d{{1,2}})(?:st|nd|rd|th)?\b"
    number = r"\d+(?:\.\d+)?(?:/\d+(?:\.\d+)?)?"
    value = F.regexp_extract(after, number, 0)
    found = (
        F.when(F.rlike(after, F.lit(date)), F.concat(F.initcap(F.regexp_extract(after, date, 1)), F.lit(" "), F.regexp_extract(after, date, 2)))
        .when(F.contains(value, F.lit("/")), F.regexp_replace(value, "^(.*)/(.*)$", r"\\frac{$1}{$2}"))
        .otherwise(value)
    )
    return F.when(F.rlike(text, F.lit(ANSWER)), found).otherwise("")


def _deleted(x: Column, *literals: str) -> Column:
    for gone in literals:
        x = F.replace(x, F.lit(gone), F.lit(""))
    return x


def _clock(x: Column) -> Column:
    clock = r"^0?(\d{1,2}):(\d{2})$"
    hour = F.regexp_extract(x, clock, 1).try_cast("int").cast("string")
    return F.when(F.rlike(x, F.lit(clock)), F.concat(hour, F.regexp_extract(x, clock, 2))).otherwise(x)


def _signs(x: Column, math: bool) -> Column:
    # One pass for each literal that deleting another could bring about, in order.
    x = F.regexp_replace(_deleted(x, "\\,", "\\!", "\\$", "$", "\\%", "%"), r"\^\{?\\circ\}?", "")
    x = _deleted(x, "\\circ", "\\\\", "£", "€")
    if not math:
        x = F.regexp_replace(F.regexp_replace(x, r"\^[234]", ""), "[²³]", "")
    x = F.regexp_replace(x, r"(?<=\d),(?=\d)", "")
    return squeeze(x if math else _deleted(x, "\\"))


def cleaning(math: bool = False) -> list[Callable[[Column], Column]]:
    """The steps of :func:`clean`, each of one column."""
    steps = [lambda x: remove_blocks(x, "\\text{", keep=math), lambda x: remove_blocks(x, "\\overline{", keep=True)]
    if not math:
        steps += [
            lambda x: fractions(x, "\\dfrac"), lambda x: fractions(x, "\\frac"),
            lambda x: remove_blocks(x, "\\begin{"), lambda x: remove_blocks(x, "\\end{"),
        ]
    return [*steps, lambda x: _signs(x, math), *([] if math else [_clock])]


def extraction(math: bool = False) -> list[Callable[[Column], Column]]:
    """Where an answer is looked for, in order."""
    return [extract_boxed, math_fallback] if math else [extract_boxed, answer_fallback, last_number]


#: What cleaning leaves as it is.
_PLAIN = r"^-?\d+(\.\d+)?$"


def clean(text: Column, math: bool = False) -> Column:
    """An extracted answer without units, formatting and LaTeX."""
    done = reduce(let, cleaning(math), text)
    return F.when(F.rlike(text, F.lit(_PLAIN)), text).otherwise(done)


def raw_answer(text: Column, math: bool = False) -> Column:
    """The first non-empty of the extraction steps, '' if all are."""
    some = lambda x: let(x, lambda v: F.when(v != "", v))
    return F.coalesce(*[some(s(text)) for s in extraction(math)], F.lit(""))


def final_answer(text: Column, math: bool = False) -> Column:
    """Extraction, then cleaning; '' where none is found."""
    return let(raw_answer(text, math), lambda raw: clean(raw, math))


def with_final_answer(rows: DataFrame, text: str = "answer", name: str = "final_answer", math: bool = False) -> DataFrame:
    """:func:`final_answer` as a column.

    Each step is a column made of the one before.  What a step reads several times
    is computed once, as ``explode`` of an array of one keeps the optimizer from
    putting the steps into each other (a filter on the result would double them at
    every step); steps with nothing to do pass by a comparison.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns]
    x, plain = F.col("_value"), F.col("_plain")

    def then(rows: DataFrame, value: Column, *more: Column) -> DataFrame:
        return rows.select(*kept, *more, F.explode(F.array(value)).alias("_value"))

    first, *others = extraction(math)
    rows = then(rows, first(F.col(text)))
    for step in others:
        rows = then(rows, F.when(x == "", step(F.col(text))).otherwise(x))
    rows = rows.select(*kept, x, F.explode(F.array(F.rlike(x, F.lit(_PLAIN)) | (x == ""))).alias("_plain"))
    for step in cleaning(math):
        rows = then(rows, F.when(plain, x).otherwise(step(x)), plain)
    return rows.select(*kept, x.alias(name))


def answer_source(text: Column, math: bool = False) -> Column:
    """Which step gave the answer."""
    if math:
        return F.when(extract_boxed(text) != "", "boxed").when(math_fallback(text) != "", "answer").otherwise("empty")
    return (
        F.when(extract_boxed(text) != "", "boxed").when(answer_fallback(text) != "", "answer")
        .when(last_number(text) != "", "last_number").otherwise("empty")
    )


def with_period(text: Column) -> Column:
    """The text and a period, as older traces have it (P10)."""
    return F.concat(text, F.lit("."))


def strip_think(text: Column) -> Column:
    """What follows the first ``</think>``, trimmed."""
    at = F.instr(text, "</think>")
    return strip(F.when(at > 0, F.substring(text, at + 8, F.length(text))).otherwise(text))


def repeats_at_end(text: Column, least: int = 4, times: int = 8) -> Column:
    """Whether the text ends in ``times`` copies of a pattern of ``least`` to 80 characters."""
    tail = F.right(text, F.lit(80 * times))
    longest = F.least(F.lit(80), F.floor(F.length(tail) / times).cast("int"))

    def repeated(n: Column) -> Column:
        end = F.right(tail, n * times)
        return end == F.repeat(F.left(end, n), F.lit(times))

    return F.when(longest >= least, F.exists(F.sequence(F.lit(least), F.greatest(longest, F.lit(least))), repeated)).otherwise(False)
