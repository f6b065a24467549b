import pytest
from pyspark.sql import functions as F

from tracemill.functions import compare as C
from tracemill.functions import text as X


def value(spark, x, f):
    return spark.createDataFrame([(x,)], "t string").select(f(F.col("t")).alias("v")).first()[0]


@pytest.mark.parametrize("x,want", [
    (r"x \boxed{\frac{1}{2}} y \boxed{3}", r"\frac{1}{2}"), ("no", ""), (r"\boxed{open {", ""),
    (r"\boxed{open \boxed{1}", ""), (r"\boxed{}", ""), (r"\boxed{a{b{c{d{e}}}}}", "a{b{c{d{e}}}}"),
])
def test_extract_boxed(spark, x, want):
    assert value(spark, x, X.extract_boxed) == want


@pytest.mark.parametrize("x,numeric,math", [
    (r"16 \text{ hours}", "16", "16 hours"), (r"\$990.00", "990.00", "990.00"), (r"50\%", "50", "50"), (r"21^\circ", "21", "21"),
    (r"1,\!000", "1000", "1000"), (r"400 \, \text{ml}", "400", "400 ml"), (r"2.\overline{6}", "2.6", "2.6"),
    (r"\dfrac{35}{6}", "35/6", r"\dfrac{35}{6}"), (r"\frac12", "12", r"\frac12"), (r"\frac{\frac{1}{2}}{3}", "frac{1}{2}/3", None),
    (r"\tfrac{1}{2}", "tfrac{1}{2}", r"\tfrac{1}{2}"), ("x^2", "x", "x^2"), ("(1,2)", "(12)", "(12)"), ("07:30", "730", "07:30"),
    ("9:00", "900", "9:00"), ("00:30", "030", "00:30"), (r"\begin{pmatrix}1\\2\end{pmatrix}", "12", r"\begin{pmatrix}12\end{pmatrix}"),
    (r"\text{hours}", "", "hours"), (r"\frac{abc", "{abc", None), (r"\frac{1}x", "{1}x", None), (r"\frac{1}{2", "1/", None),
])
def test_clean(spark, x, numeric, math):
    assert value(spark, x, X.clean) == numeric
    if math is not None:
        assert value(spark, x, lambda t: X.clean(t, True)) == math


@pytest.mark.parametrize("x,gone,kept", [
    (r"\text{a{b}c} d", " d", "a{b}c d"), (r"\text{\text{x}}", "", r"\text{x}"), (r"\text{abc", "", "ab"), (r"\text{", "", ""), (r"a}b\text{c}}", "a}b}", "a}bc}"),
])
def test_blocks(spark, x, gone, kept):
    assert value(spark, x, lambda t: X.remove_blocks(t, r"\text{")) == gone
    assert value(spark, x, lambda t: X.remove_blocks(t, r"\text{", True)) == kept


def test_truths(spark):
    assert value(spark, "a #### 1 #### 18 ", X.hash_answer) == "18"
    assert value(spark, "none", X.hash_answer) is None
    for x, want in ((r"\boxed{1} \boxed{2}", "2"), (r"\fbox{7}", "7"), (r"\boxed{}", ""), ("none", None), (r"\boxed{1", None)):
        assert value(spark, x, X.last_boxed_content) == want


def test_fallbacks(spark):
    text = "465,000 - 20,000 = 445,000\n**Answer**: it is 445,000 after 20,000"
    assert value(spark, text, X.answer_fallback) == "445,000"
    assert value(spark, text, X.final_answer) == "445000"
    assert value(spark, "**Final Answer:** 3", X.answer_fallback) == ""
    assert value(spark, "I have 3 apples.", X.last_number) == "3" and value(spark, "I have 3 apples", X.last_number) == ""
    for x, want in (("June 20th", "June 20"), ("june 20th", "June 20"), ("Sept 3", "3"), ("4/5", r"\frac{4}{5}"), ("1,000", "1"), ("-5", "5")):
        assert value(spark, "**Answer:** " + x, X.math_fallback) == want
    assert value(spark, "-5 and 1,234.5 or 1234,567", X.numbers) == ["5", "1,234.5", "1234", "567"]


@pytest.mark.parametrize("x,want", [
    ("Jan 5", "Jan 5"), ("Dec 25th", "Dec 25"), ("may 3rd", "May 3"), ("SEP 1", "Sep 1"), ("In total 5 on June 20", "5"), ("3 apples in May 7", "3"),
    ("June 201", "201"), ("June 20thx", "20"), ("June 20.", "June 20"), ("about 3.5/4", r"\frac{3.5}{4}"), ("none", ""),
])
def test_dates(spark, x, want):
    assert value(spark, "**Answer**: " + x, X.math_fallback) == want


@pytest.mark.parametrize("math", [False, True])
def test_steps_as_columns(spark, math):
    """One column a step gives what the single expression gives, also under a filter."""
    texts = [r"\boxed{\frac{1}{\text{a{b}}}}", r"\boxed{12}", r"\boxed{\dfrac{1}{2} \text{ m}}", "**Answer:** Jan 5", "3 of 1,234.", "", None, r"\boxed{07:30}", r"\boxed{\text{open", r"\boxed{\overline{\overline{3}}}"]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "k int, answer string, _value string").drop("_value")
    got = X.with_final_answer(rows, math=math)
    want = rows.withColumn("final_answer", X.final_answer(F.col("answer"), math))
    assert sorted(got.collect(), key=lambda r: r.k) == sorted(want.collect(), key=lambda r: r.k)
    assert got.where("final_answer = ''").count() == want.where("final_answer = ''").count()


def test_validity(spark):
    for x in ("35/6", "-3/4", "990.00", "1/0"):
        assert value(spark, x, C.is_numeric)
    for x in ("", ".5", "5.", "1,000", "+5", "64 32", "3/-4"):
        assert not value(spark, x, C.is_numeric)
    assert value(spark, "1,000", C.number_value) == 1000.0
    for x in ("1/0", "1/2/3", "abc", "12d"):
        assert value(spark, x, C.number_value) is None


def test_think_and_repeats(spark):
    assert value(spark, "a</think> b</think> c", X.strip_think) == "b</think> c"
    for x, want in (("x" + "\nmoire" * 8, True), ("ab" * 16, True), ("ab" * 15, False), ("hello world", False), ("", False)):
        assert value(spark, x, X.repeats_at_end) is want
