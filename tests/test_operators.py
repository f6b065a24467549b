import json
import random

from pyspark.sql import functions as F

from tracemill.operators import adaptive, assemble, dedup, grade, metrics, report
from tracemill.plans.checkpoints import ensure_checkpoint_dir
from tracemill.plans.registry import fake_provider
from tracemill.sources import jsonl


def test_grading_and_identities(spark):
    samples = spark.createDataFrame(
        [("a", r"\boxed{1}"), ("a", r"\boxed{2}"), ("b", "none"), ("c", r"\boxed{x}"), ("d", r"\boxed{4}"), ("e", r"\boxed{1/0}")], "problem string, answer string"
    )
    truth = grade.last_truth(spark.createDataFrame([("a", "9", 0), ("a", "1", 1), ("b", "1", 2), ("c", "1", 3), ("e", "3", 4)], "problem string, answer string, ord int"))
    graded = grade.grade(samples, truth)
    c = metrics.summary(graded).first()
    assert (c.total, c.empty, c.non_numeric, c.valid, c.correct) == (6, 1, 1, 4, 1)
    assert grade.incorrect_rows(graded).count() == 1 and grade.incorrect_rows(graded, adaptive=True).count() == 4
    assert [r.problem for r in grade.missing_truth(graded).collect()] == ["d"]
    p = metrics.problem_level(graded).first()
    assert (p.problems, p.with_truth, p.all_correct, p.any_correct, p.none_correct) == (5, 4, 0, 1, 3)
    assert metrics.summary(graded.limit(0)).first().accuracy == 0.0


def test_greedy_and_pairwise(spark):
    def unit(a):
        import math

        return [math.cos(a), math.sin(a)]

    rows = spark.createDataFrame([("p", 0, unit(0)), ("p", 1, unit(0.3)), ("p", 2, unit(1.0)), ("q", 3, unit(0))], "problem string, ord int, v array<double>")
    assert sorted(r.ord for r in dedup.greedy_dedup(rows, "problem", "ord", "v", 0.9).collect()) == [0, 2, 3]
    a, b = rows, rows.where("ord < 2").withColumn("ord", F.col("ord") + 10)
    kept = dedup.pairwise_dedup(a, b, "ord", "v", 0.92).orderBy("pos", "side").collect()
    assert [r.ord for r in kept] == [0, 1, 2, 3]


def test_greedy_large_groups(spark):
    """Groups in Arrow blocks, of one expression and of one sample choose alike."""
    import numpy as np

    x = np.random.default_rng(0).normal(size=(400, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([("f" if k < 300 else "g", 0 if k < 300 else k // 7, k, v.tolist()) for k, v in enumerate(x)], "file string, problem int, ord int, v array<double>")
    want, kept = set(), {}
    for k, v in enumerate(x):
        group = kept.setdefault(("f", 0) if k < 300 else ("g", k // 7), [])
        if all(float(v @ w) <= 0.9 for w in group):
            group.append(v)
            want.add(k)
    assert {r.ord for r in dedup.greedy_dedup(rows, ("file", "problem"), "ord", "v", 0.9).collect()} == want
    stats = {r.file: r for r in dedup.dedup_stats(rows, dedup.greedy_dedup(rows, ("file", "problem"), "ord", "v", 0.9), "file", "problem", by="file").collect()}
    assert stats[None].before == 400 and stats[None].after == len(want) and stats["f"].problems == 1 and stats["f"].pairs_total == 299


def test_dedup_stats_count_before(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), ("c", 5), ("c", 6), ("c", 7)], "problem string, ord int")
    s = dedup.dedup_stats(rows, rows.where("ord in (1, 3, 4, 5)"), "problem").first()
    assert (s.one, s.two, s.more, s.pairs_total, s.pairs_above, s.discarded) == (1, 1, 1, 4, 3, 3)


def test_positions_and_statistics(spark):
    rows = spark.createDataFrame([(float(k * k % 101),) for k in range(1, 100)] + [(5.0,)] * 50, "sim double")
    got = dedup.positions(rows, "sim").orderBy("pos").collect()
    values = [r.sim for r in got]
    assert [r.pos for r in got] == list(range(1, 150)) and values == sorted(values)
    s = metrics.similarity_stats(rows).first()
    assert s.mid == values[74] and s.n == 149 and metrics.similarity_stats(rows.limit(0)).first().mid is None
    edges = spark.createDataFrame([(x,) for x in (-0.1, 0.0, 0.5, 0.969, 0.97, 0.985, 0.99, 1.0)], "sim double")
    assert {r.lo: r.n for r in metrics.similarity_histogram(edges).collect() if r.n} == {0.0: 1, 0.5: 1, 0.95: 1, 0.97: 1, 0.98: 1, 0.99: 1}


def test_embed(spark):
    import numpy as np

    seen = []

    def encoder(texts):
        assert len(texts) <= 2
        return np.array([[len(t), 1.0] for t in texts])

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["abc", "", None, "x", "yz"])], "k int, text string").coalesce(1)
    got = {r.k: r.embedding for r in dedup.embed(rows, encoder, "text", batch=2).collect()}
    assert got[1] == got[2] == [0.0, 1.0] and abs(got[0][0] - 3 / 10**0.5) < 1e-12 and not seen


def test_evaluate(spark, tmp_path):
    from tracemill.operators import evaluate

    problems = spark.createDataFrame([("a", "1", "t", "l"), ("b", "2", "t", "k"), ("c", "3", "u", "l"), ("d", "x", None, None)], "problem string, answer string, type string, level string")

    def model(rows, settings):
        assert settings.top_p == 0.95
        return rows.withColumn("generated", F.when(F.col("problem") == "c", "no").otherwise(F.concat(F.lit("<think>\\boxed{9}</think>\\boxed{"), F.col("answer"), F.lit("}"))))

    settings = evaluate.Settings(clean_tags=True, max_samples=3)
    done = evaluate.evaluate_all({"one": (problems, False), "two": (problems, True)}, model, settings, output=str(tmp_path / "p.jsonl"), report_path=str(tmp_path / "r.txt"))
    assert (done["one"]["total"], done["one"]["correct"], done["one"]["empty"], done["two"]["correct"]) == (3, 2, 1, 2)
    text = (tmp_path / "r_one.txt").read_text()
    assert "Accuracy: 66.67%" in text and "By type" in text and "Non-numeric" in text and "Non-numeric" not in (tmp_path / "r_two.txt").read_text()
    rows = spark.read.json(str(tmp_path / "p_two.jsonl")).collect()
    assert {r.problem: r.is_correct for r in rows} == {"a": True, "b": True, "c": False}
    # Without cleaning the tags the first box is the one thought aloud.
    assert evaluate.predict(problems, model, evaluate.BASELINE).where("is_correct").count() == 0
    assert report.dataset_summary([done["two"], done["one"]]).startswith("one ")


def test_providers(spark):
    from tracemill.operators import evaluate, provider

    def load(settings):
        def generate(prompts):
            assert 0 < len(prompts) <= 2 and prompts[0][-1]["content"].startswith("Problem: ") and prompts[0][0]["content"] == settings.system
            return [["\\boxed{" + str(len(p[-1]["content"]) - 9) + "}"] for p in prompts]

        return generate

    problems = spark.createDataFrame([("a", "1", None, None), ("bb", "2", None, None), ("ccc", "4", None, None)], "problem string, answer string, type string, level string").coalesce(1)
    got = {r.problem: (r.final_answer, r.is_correct) for r in evaluate.predict(problems, provider.evaluated(load, batch=2), evaluate.BASELINE).collect()}
    assert got == {"a": ("1", True), "bb": ("2", True), "ccc": ("3", False)}

    def load_sampler(temperature, n):
        return lambda prompts: [[(f"{p[-1]['content']} {k}", [-1.0 if p[-1]["content"] == "a" else -5.0, None]) for k in range(n)] for p in prompts]

    ensure_checkpoint_dir(spark)
    made = adaptive.adaptive_sample(problems, provider.sampled(load_sampler, batch=2), max_iters=1)
    assert dict(made.groupBy("problem").count().collect()) == {"a": 3, "bb": 5, "ccc": 5} and made.where("answer = 'a 2' and round = 1").count() == 1


def test_exports_defaults_and_appending(spark, tmp_path):
    rows = spark.createDataFrame([("p", "s", 1)], "problem string, solution string, other int")
    rows.write.parquet(str(tmp_path / "e"))
    got = jsonl.read_export(spark, str(tmp_path / "e")).first()
    assert got.asDict() == {"problem": "p", "solution": "s", "type": None, "level": None}
    filled = jsonl.with_defaults(spark.createDataFrame([("p", None), ("q", 2)], "problem string, round int")).orderBy("problem").collect()
    assert [(r.round, r.final_answer, r.type) for r in filled] == [(0, "", ""), (2, "", "")]
    for _ in range(2):
        jsonl.write_jsonl(rows, str(tmp_path / "out.jsonl"), append=True)
    assert jsonl.read_export(spark, str(tmp_path / "out.jsonl")).count() == 2


def test_boxed_loader_with_split(spark, tmp_path):
    raw = spark.createDataFrame([(f"p{k % 40}", "\\boxed{%d}" % (k % 40) if k % 8 else "none", "t", "l") for k in range(80)], "problem string, solution string, type string, level string")
    done = jsonl.split_boxed(raw, str(tmp_path / "train"), str(tmp_path / "test"))
    assert done == {"train": 63, "test": 7, "missing": 10}
    train, test = (spark.read.json(str(tmp_path / n)) for n in ("train", "test"))
    assert train.count() == 63 and test.count() == 7 and set(train.columns) == {"problem", "answer", "type", "level"}


def test_sections_of_reports():
    c = {"total": 10, "empty": 1, "non_numeric": 1, "valid": 8, "correct": 4}
    problems = {"problems": 5, "with_truth": 4, "all_correct": 1, "any_correct": 3, "none_correct": 1, "avg_samples": 2.0}
    rounds = [{**c, "round": 10}, {**c, "round": 2}]
    text = report.full_report("T", c, problems=problems, types=[{**c, "name": "b"}, {**c, "name": "a"}], rounds=rounds)
    assert "Any correct: 3 (75.0%)" in text and "Without a truth: 1" in text and text.index("Round 2:") < text.index("Round 10:") and "By level" not in text
    assert report.round_section(rounds[:1]) == "" and "0.0%" in report.problem_section({**problems, "with_truth": 0})


def test_split_is_exact_and_shuffle_repeats(spark):
    rows = spark.range(1003)
    assert assemble.split(rows, "id").where("part = 'train'").count() == 902
    assert assemble.shuffle(rows, "id").collect() == assemble.shuffle(rows.repartition(3), "id").collect()


def test_adaptive_rounds(spark):
    ensure_checkpoint_dir(spark)
    problems = spark.createDataFrame([("order 1",), ("order 3",), ("order 6",)], "problem string")
    made = adaptive.adaptive_sample(problems, fake_provider)
    assert dict(made.groupBy("problem").count().collect()) == {"order 1": 3, "order 3": 7, "order 6": 11}
    assert {r.answer for r in made.where("problem = 'order 1'").collect()} == {"order 1 at 1"}
    assert [(r.round, r.high, r.low) for r in adaptive.confidence_by_round(made).orderBy("round").collect()][:3] == [(1, 1, 2), (2, 0, 2), (3, 1, 1)]
    assert spark.range(1).select(adaptive.confident(F.array(F.lit(-2.0), F.lit(-1.8)))).first()[0] is True
    assert spark.range(1).select(adaptive.confident(F.array(F.lit(None).cast("double")))).first()[0] is False


def test_jsonl_round_trip(spark, tmp_path):
    (tmp_path / "blank.jsonl").write_text("a\n \t \n\u00a0\n\t\nb ")
    assert [r.value for r in jsonl.read_lines(spark, str(tmp_path / "blank.jsonl")).collect()] == ["a", "b "]
    (tmp_path / "in.jsonl").write_text('{"problem": "p", "answer": "é"}\n\n{"problem": "q", "answer": "x", "type": "t"}\n')
    rows = jsonl.read_jsonl(spark, str(tmp_path / "in.jsonl"), jsonl.PROBLEM)
    assert rows.count() == 2 and jsonl.read_lines(spark, str(tmp_path / "in.jsonl")).count() == 2
    done = jsonl.fan_out(rows, {"t": (str(tmp_path / "t"), F.col("type") == "t"), "none": (str(tmp_path / "none"), F.col("type") == "u")})
    assert done == {"t": 1, "none": 0} and not (tmp_path / "none").exists()
    (part,) = (tmp_path / "t").glob("part*")
    assert json.loads(part.read_text()) == {"problem": "q", "answer": "x", "type": "t"}
    assert jsonl.suffixed("report.txt", "gsm8k") == "report_gsm8k.txt"


def test_report_numbers():
    text = report.summary_report("Report", {"total": 7473, "empty": 163, "non_numeric": 16, "valid": 7294, "correct": 6298})
    assert "Accuracy: 84.28%" in text and "Valid accuracy: 86.34%" in text and "Incorrect: 996" in text


def test_stream(spark, tmp_path):
    from tracemill.streaming.extract import graded_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"problem": "p", "answer": "\\\\boxed{5}"}\n')
    truth = spark.createDataFrame([("p", "5")], "problem string, ground_truth string")
    name = f"s{random.randrange(10**6)}"
    q = graded_stream(spark, str(tmp_path / "in"), jsonl.PROBLEM, truth).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.is_correct for r in spark.table(name).collect()] == [True]
