"""Plain-text reports, rendered on the driver from a few counters, and their sink.

Counters are dicts as the rows of ``metrics.summary``: total, empty,
non_numeric, valid, correct; those of a group also have ``name``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _rate(part: int, whole: int) -> float:
    return 100 * part / whole if whole else 0.0


def _share(part: int, whole: int) -> str:
    return f"{part} ({_rate(part, whole):.1f}%)"


def summary_report(title: str, c: dict) -> str:
    """The samples and their accuracy; ``non_numeric`` may be absent or None."""
    lines = [title, "=" * len(title), f"Total samples: {c['total']}", f"Empty: {_share(c['empty'], c['total'])}"]
    if c.get("non_numeric") is not None:
        lines.append(f"Non-numeric: {_share(c['non_numeric'], c['total'])}")
    lines += [f"Valid: {_share(c['valid'], c['total'])}", f"Correct: {c['correct']}", f"Incorrect: {c['valid'] - c['correct']}", ""]
    lines += [f"Accuracy: {_rate(c['correct'], c['total']):.2f}%", f"Valid accuracy: {_rate(c['correct'], c['valid']):.2f}%"]
    return "\n".join(lines) + "\n"


def problem_section(c: dict) -> str:
    """``c``: a row of ``metrics.problem_level``; shares are of the problems with a truth."""
    known, missing = c["with_truth"], c["problems"] - c["with_truth"]
    lines = ["Problems", "--------", f"Problems: {c['problems']}", f"With a truth: {known}"]
    lines += [f"{name} correct: {_share(c[f'{key}_correct'], known)}" for name, key in (("All", "all"), ("Any", "any"), ("None", "none"))]
    lines += [f"Without a truth: {missing}"] if missing else []
    return "\n".join([*lines, f"Samples a problem: {c['avg_samples']:.1f}"]) + "\n"


def category_table(rows: list[dict], width: int = 12) -> str:
    """Lines of name, correct / total and accuracy, in order of name."""
    out = []
    for r in sorted(rows, key=lambda r: r["name"]):
        out.append(f"{r['name']:<{width}} {r['correct']:>6}/{r['total']:<6} {_rate(r['correct'], r['total']):5.1f}%")
    return "\n".join(out) + "\n"


def round_section(rows: list[dict]) -> str:
    """A line for each round, by number; nothing where there is one round only."""
    if len(rows) < 2:
        return ""
    lines = ["Rounds", "------"]
    for r in sorted(rows, key=lambda r: int(r["round"])):
        lines.append(
            f"Round {r['round']}: total {r['total']}, empty {r['empty']}, non-numeric {r['non_numeric']}, valid {r['valid']}, correct {r['correct']}, "
            f"accuracy {_rate(r['correct'], r['total']):.1f}%, valid accuracy {_rate(r['correct'], r['valid']):.1f}%"
        )
    return "\n".join(lines) + "\n"


def full_report(title: str, total: dict, *, problems: dict | None = None, types: list[dict] = (), levels: list[dict] = (), rounds: list[dict] = ()) -> str:
    """All sections there is something for, with blank lines between them."""
    parts = [summary_report(title, total), problem_section(problems) if problems else "", round_section(list(rounds))]
    parts += [f"By {name}\n" + category_table(list(rows), 26) for name, rows in (("type", types), ("level", levels)) if rows]
    return "\n".join(p for p in parts if p)


def dataset_summary(rows: list[dict]) -> str:
    """A line for each dataset, in order of name (``rows`` of ``metrics.summary`` by dataset)."""
    return "".join(
        f"{r['dataset']:<8} correct {r['correct']}/{r['total']}, accuracy {_rate(r['correct'], r['total']):.2f}%, "
        f"valid accuracy {_rate(r['correct'], r['valid']):.2f}%, empty {r['empty']}\n"
        for r in sorted(rows, key=lambda r: r["dataset"])
    )


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file at ``path`` in any file system that Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
