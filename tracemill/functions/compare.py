"""Validity, numeric value and equality of answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze, strip

NUMERIC = r"^-?\d+(\.\d+)?(/\d+(\.\d+)?)?$"
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def is_numeric(x: Column) -> Column:
    """A plain number or a fraction of two; '' is not."""
    return F.rlike(x, F.lit(NUMERIC))


def number_kind(x: Column) -> Column:
    """Whether an answer is a number, a fraction, empty or something other."""
    return F.when(x == "", "empty").when(is_numeric(x), F.when(F.contains(x, F.lit("/")), "fraction").otherwise("number")).otherwise("other")


def number_value(x: Column) -> Column:
    """Value of a number or fraction with commas; null where there is none."""
    bare = F.replace(strip(x), F.lit(","), F.lit(""))
    parts = F.split(bare, "/")
    one = lambda p: F.when(F.rlike(strip(p), F.lit(_FLOAT)), strip(p).try_cast("double"))
    return F.when(F.size(parts) == 1, one(bare)).when(
        F.size(parts) == 2, F.try_divide(one(F.get(parts, F.lit(0))), one(F.get(parts, F.lit(1))))
    )


def same_number(a: Column, b: Column) -> Column:
    return F.abs(number_value(a) - number_value(b)) < 1e-9


def same_text(a: Column, b: Column) -> Column:
    return squeeze(a) == squeeze(b)


def is_correct(answer: Column, truth: Column, math: bool = False) -> Column:
    """Whether the answer equals the truth; false where either is missing."""
    equal = same_text(answer, truth) if math else same_number(answer, truth)
    return F.coalesce(equal, F.lit(False))
