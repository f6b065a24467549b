"""Every stage of the pipeline on awkward rows, and the whole against its operators."""

import pytest

from tests.llm.test_brute_force import prose, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, record string, part int"


@pytest.fixture(scope="module")
def pipeline():
    import corpus_pipeline

    return corpus_pipeline


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    base = prose(1)
    near = base.split()
    near[50] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, prose(6, 20_000)), (7, prose(7)), (7, prose(7)), (None, prose(8)),
        (9, "mail me: a.b@c.com 你好 é"), (10, "..."), (11, "mail me: a.b@c.com 你好 é"),
    ]
    rows = [(i, t, "en" if k % 3 else None, "s", len(t or ""), 5, "r", 6) for k, (i, t) in enumerate(texts)]
    return table(spark, tmp_path_factory.mktemp("p") / "d", rows, SCHEMA, files=3)


def test_stages(spark, docs, pipeline):
    stages = dict(pipeline.STAGES)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.where("doc_id = -1"), "").count() == 0, name
        assert name == "packed" or stage(spark, docs, "").columns == docs.columns, name
    left = {name: [(r.doc_id, r.text) for r in stages[name](spark, docs, "").collect()] for name in ("language", "exact", "near", "private")}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same = lambda got, want: sorted(got, key=repr) == sorted(want, key=repr)
    assert same(left["language"], [x for x in rows if x[1] and x[1] != "..."])
    assert same([d for d, _ in left["exact"]], [2, 3, 5, 6, 7, None, 10, 11])
    assert same([d for d, _ in left["near"]], [1, 4, 5, 6, 7, None, 9, 10])
    assert len(left["private"]) == len(rows) and all(t == dict(rows)[d] for d, t in left["private"] if d not in (9, 11))
    assert len({t for d, t in left["private"] if d in (9, 11)}) == 1 and "a.b@c.com" not in dict(left["private"])[9]
    assert {r.doc_id for r in stages["packed"](spark, docs, "").collect()} == {d for d, _ in rows}


def test_run(spark, docs, pipeline, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {2, 6, 7, None, 11} and set(got.columns) >= {"doc_id", "sequence_id", "offset"}
    again = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    (tmp_path / "none").mkdir()
    again.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_batches_of_python_workers_are_bounded_in_bytes(spark, pipeline, monkeypatch):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["row", "n", "bytes"])

    monkeypatch.setattr(pipeline.packing, "pack", lambda docs: docs.mapInArrow(sizes, "row long, n long, bytes long"))
    docs = spark.newSession().range(0, 6_000, 1, 1).selectExpr("id AS doc_id", "repeat('abcdefgh ', if(id = 7, 1000000, 500)) AS text")
    got = pipeline.packed(docs.sparkSession, docs, "").collect()
    assert len(got) > 6 and sum(r.n for r in got) == 6_000 and sum(r.bytes for r in got) > 35_000_000
    # The long text comes whole; the others beside it are no more than a batch.
    assert sorted(r.bytes for r in got)[-2] < 5 << 20 and max(r.bytes for r in got) < 14 << 20
