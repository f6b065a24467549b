"""Operators against plain versions of themselves."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracemill.llm import ann, common, exactdedup, langid, linededup, matching, materialise, neardedup, packing, sharding

WORDS = [f"w{i}" for i in range(400)]
SF = "/root/testdata/sf0.01"


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def table(spark, path, rows, schema="doc_id long, text string", files=1):
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(str(path))
    return spark.read.parquet(str(path))


# Sharding ----------------------------------------------------------------------------------------

def test_shards_do_not_depend_on_files(spark, tmp_path):
    rows = [(k, prose(k, 5)) for k in range(300)] + [(None, None), (None, ""), (7, prose(7, 5))] + [(5, "again")] * 20
    options = {"bucket_bytes": 2_000, "seed": 3}
    places = []
    for files in (1, 5):
        got = sharding.shard(table(spark, tmp_path / f"d{files}", rows, files=files), 8, **options).collect()
        assert Counter((r.record.doc_id, r.record.text) for r in got) == Counter(rows)
        by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
        assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
        places.append({(r.shard, r.slot): (r.record.doc_id, r.record.text) for r in got})
    assert places[0] == places[1]
    again = sharding.shard(table(spark, tmp_path / "again", rows), 8, bucket_bytes=2_000, seed=4).collect()
    assert {(r.shard, r.slot): (r.record.doc_id, r.record.text) for r in again} != places[0]


def test_shards_send_no_records_to_python(spark, tmp_path, monkeypatch):
    made, plain = [], sharding.written

    def written(df, name, *args, **options):
        made.append((name, df))
        return plain(df, name, *args, **options)

    monkeypatch.setattr(sharding, "written", written)
    rows = [(i, f"text {i} " + "x" * (i % 50)) for i in range(600)] + [(None, None), (7, ""), (7, "")]
    got, n = sharding.external_shuffle(table(spark, tmp_path / "d", rows), seed=3, bucket_bytes=8_000)
    (shuffled,) = [df for name, df in made if name == "shuffled"]
    nodes = str(shuffled._jdf.queryExecution().optimizedPlan()).splitlines()
    python = [line for line in nodes if re.search("InArrow|InPandas|EvalPython", line)]
    assert python and not any("record" in line for line in python)
    # The places grow with the rows: never broadcast.
    assert any("strategy=merge" in line for line in nodes)
    # Each bucket: its rows in the order of key and place, shuffled by Fisher-Yates.
    by = {}
    for r in got.withColumn("key", F.xxhash64(F.lit(3), "record.doc_id", "record.text")).collect():
        by.setdefault(r.bucket, []).append((r.pos, r.key))
    assert n == len(rows) == sum(map(len, by.values())) and len(by) > 3
    for bucket, found in by.items():
        keys = sorted(k for _, k in found)
        order = np.arange(len(keys))
        np.random.Generator(np.random.PCG64([3, bucket])).shuffle(order)
        assert sorted(found) == [(pos, keys[rank]) for pos, rank in enumerate(order)]


def test_shards_of_repeated_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "REPEATS", 10)
    got, _ = sharding.external_shuffle(table(spark, tmp_path / "d", [(1, "same")] * 400), bucket_bytes=1_000)
    sizes = [r[1] for r in got.groupBy("bucket").count().collect()]
    assert sum(sizes) == 400 and len(sizes) > 5 and max(sizes) < 100


# Nearest neighbours ------------------------------------------------------------------------------

def test_quantiser_alone(spark, tmp_path):
    """Recall of the codes, without the second scan, beyond the rows fitted."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 32))
    e = table(spark, tmp_path / "e", list(enumerate(x.tolist())), "vec_id long, embedding array<double>", files=3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.search(e, F.col("vec_id") % 50 == 0, rerank=20, sample_rows=2000, complete=False).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 4000, 50):
        score = unit @ unit[q]
        score[q] = -9
        hits += len(got[q] & set(np.argsort(-score)[:5].tolist()))
    assert hits / 400 >= 0.95
    books = ann.Codebooks.fit(unit[:2000])
    codes, norms = books.encode(unit[2000:])
    made = books.words[np.arange(codes.shape[1]), codes].sum(1)
    assert np.allclose(np.linalg.norm(made, axis=1), norms, atol=1e-4) and np.square(made - unit[2000:]).sum(1).mean() < 0.2
    greedy, _ = books.encode(unit[2000:], beam=1)
    worse = books.words[np.arange(greedy.shape[1]), greedy].sum(1)
    assert np.square(made - unit[2000:]).sum(1).mean() <= np.square(worse - unit[2000:]).sum(1).mean()


def test_nearest_of_odd_vectors(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (5, [float("inf"), 1.0])]
    got = ann.search(table(spark, tmp_path / "e", rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]


# Packing and training order ----------------------------------------------------------------------

def best_fit(lengths, capacity):
    """The plain version: one piece after the other, longest first, to the fullest sequence with room."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(capacity - n)
    return len(room)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    return [(k, prose(k, r.choice((1, 3, 20, 60, 200)))) for k in range(150)] + [(None, None), (200, ""), (201, "Ünï 你好 <|endoftext|>"), (7, prose(7, 3000))]


def library_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_packing(spark, tmp_path, texts):
    capacity = 128
    rows = packing.pack(table(spark, tmp_path / "d", texts, files=3), capacity=capacity).collect()
    ids = {(d, t): library_ids(t) for d, t in texts}
    want = []
    for (d, _), x in ids.items():
        want += [(d, k, s, len(x[s : s + capacity]), zlib.crc32(struct.pack(f"<{len(x[s : s + capacity])}I", *x[s : s + capacity]))) for k, s in enumerate(range(0, len(x), capacity))]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(want)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1].tolist()] and ends[-1] <= capacity
    assert len(sequences) == best_fit([w[3] for w in want], capacity)


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit(seed):
    r = random.Random(seed)
    lengths = [r.choice((1, 2, 3, 5, 8, 13, 30, 31, 50, 64, r.randint(1, 64))) for _ in range(500)]
    plan = packing.plan_best_fit(Counter(lengths), 64)
    assert sum(p[2] for p in plan) == 500 and len({p[3] + k for p in plan for k in range(-(-p[2] // p[4]))}) == best_fit(lengths, 64)


def test_training_order_holds_the_ids(spark, tmp_path, texts):
    docs = table(spark, tmp_path / "d", texts, files=2)
    path, index = materialise.materialise(docs, length=33, shard_sequences=16, key=9)
    n = index.count()
    read = {r.slot: np.frombuffer(r.data, "<u2") for r in materialise.read_shards(spark, path).collect()}
    part_of = {r.slot: (r.sequence, r.used) for r in index.collect()}
    stream = [t for s in sorted(part_of, key=lambda s: part_of[s][0]) for t in read[s][: part_of[s][1]].tolist()]
    found = Counter()
    start = 0
    for k, t in enumerate(stream):
        if t == 0:
            found[tuple(stream[start : k + 1])] += 1
            start = k + 1
    assert found == Counter(tuple(library_ids(t)) for _, t in texts) and all(x[-1] == 0 for x in read.values())
    slots = materialise.feistel(np.arange(n), n, 9)
    assert all(slots[s] == slot for slot, (s, _) in part_of.items()) and sorted(part_of) == list(range(n))
    folder = path.removeprefix("file://")
    for start in (0, 5, 16, n - 1, n):
        rest = list(materialise.read_from(folder, start))
        assert [s for s, _ in rest] == list(range(start, n)) and all((x == read[s]).all() for s, x in rest)
        assert sorted(r.slot for r in materialise.read_shards(spark, path, start=start, data=False).collect()) == list(range(start, n))
    assert materialise.manifest_of(spark, path)["sequences"] == n


def test_large_ids_are_refused(monkeypatch):
    class Words:
        def batch(self, texts):
            return [np.array([70_000], "<u4").tobytes() for _ in texts]

    monkeypatch.setattr(materialise, "word_ids", lambda path: Words())
    monkeypatch.setattr(materialise.TaskContext, "get", classmethod(lambda cls: type("C", (), {"partitionId": lambda self: 0})()))
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["x"])], names=["doc_id", "text"])
    with pytest.raises(ValueError, match="16 bits"):
        list(materialise._cut(8, None)(iter([batch])))


# Language ----------------------------------------------------------------------------------------

def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.predict(docs.withColumn("held", langid.held_out("doc_id")), *langid.fit(docs), keep=("lang", "held")).where("held and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.predict(empty, *langid.fit(empty)).count() == 0
    none = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(none, *langid.fit(none)).collect()} == {"und"}


# Exact deduplication -----------------------------------------------------------------------------

@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(spark, tmp_path, keep):
    r = random.Random(5)
    low, high = -(2**63), 2**63 - 1
    rows = [(r.choice([None, low, high, -3, *range(50)]), r.choice([None, "", "a", "b" * 50, *map(str, range(40))])) for _ in range(600)]
    got = exactdedup.exact_dedup(table(spark, tmp_path / "d", rows, files=9), keep=keep).collect()
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    texts = {hashlib.sha256(t.encode()).digest(): t for t in groups}
    assert len(got) == len(rows) and sum(x.kept for x in got) == len(groups)
    for x in got:
        ids = [i for i in groups[texts[bytes(x.digest)]] if i is not None]
        best = (max if keep == "largest" else min)(ids, default=None)
        assert x.keep_id == best and x.group_size == len(groups[texts[bytes(x.digest)]]) and (not x.kept or x.doc_id == best)


def test_runs_merge_in_order():
    rng = np.random.default_rng(0)
    runs = []
    for k in range(7):
        n = int(rng.integers(0, 40))
        keys = np.array([f"{v:040d}" for v in rng.integers(0, 60, n)], "S40")
        runs.append(exactdedup.sorted_run(keys, rng.integers(-5, 5, n), np.arange(n) + 100 * k, rng.integers(0, 2, n).astype(np.uint8)))
    whole = exactdedup.merged(runs)
    assert (whole["keys"][1:] > whole["keys"][:-1]).all() and whole["counts"].sum() == sum(r["counts"].sum() for r in runs)
    for key, i, known in zip(whole["keys"], whole["ids"], whole["known"], strict=True):
        there = [x for r in runs for k, x, n in zip(r["keys"], r["ids"], r["known"], strict=True) if k == key and n]
        assert (i == max(there)) if there else not known
    with pytest.raises(ValueError, match="order"):
        exactdedup.merge_two(runs[0], {k: v[::-1] for k, v in whole.items()})


# Near duplicates and lines -----------------------------------------------------------------------

def test_shared_keys(monkeypatch):
    """Keys that come again are told whatever is held together."""
    rng = np.random.default_rng(2)
    keys, rows = rng.integers(0, 300, 1000), np.arange(1000)
    want = {(int(k), int(r)) for k, r in zip(keys, rows, strict=True) if (keys == k).sum() > 1}
    for held in (50, 10_000):
        monkeypatch.setattr(matching, "KEYS_HELD", held)
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + 60]), pa.array(rows[k : k + 60])], names=["key", "row"]) for k in range(0, 1000, 60)]
        out = [t for b in matching._shared(iter(batches)) for t in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)]
        assert Counter((k, r) for k, r, _ in out) == Counter(want)
        first = {}
        assert all(first.setdefault(k, f) == f for k, _, f in out) and all((k, f) in want for k, f in first.items())


def test_the_bound_loses_no_pair():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 400, dtype=np.uint64)
    sets = []
    for k in range(120):
        base = pool[(k // 6) * 10 : (k // 6) * 10 + 200] if k % 2 else rng.choice(pool, 150, replace=False)
        hashes = np.unique(rng.choice(base, int(len(base) * rng.uniform(0.8, 1)), replace=False))
        sets.append((hashes, (1 + hashes % np.uint64(3)).astype(float) * rng.choice([1, 1, 2], len(hashes))))
    i, j = map(np.array, zip(*[(a, b) for a in range(120) for b in range(a)], strict=True))
    found = matching.may_reach(matching.sketches(sets, 1024), i, j, 0.6)
    exact = np.array([matching.weighted_jaccard(sets[a], sets[b]) for a, b in zip(i, j, strict=True)])
    assert (exact >= 0.6).sum() > 20 and found[exact >= 0.6].all() and found.mean() < 0.9


def test_long_near_copies():
    """Samples agree as often as the similarity says, though shingles share their draws."""
    r, make, sample = random.Random(8), neardedup.Features({}, 10), neardedup.Sampler()
    for n in (300, 20_000):
        agreed, similar = [], []
        for _ in range(20 if n < 1000 else 6):
            words = [f"x{r.randrange(10**6)}" for _ in range(n)]
            other = list(words)
            for k in r.sample(range(n), n // 50):
                other[k] = f"y{r.randrange(10**6)}"
            a, b = make(words), make(other)
            agreed.append((sample(*a) == sample(*b)).mean())
            similar.append(matching.weighted_jaccard(a, b))
        assert abs(np.mean(agreed) - np.mean(similar)) < 0.05


def test_features_cost_little_more_than_hashes():
    """The features of many lines are those of each, and take less than 3.5 times as long as their hashes alone."""
    r = random.Random(4)
    lines = ["".join(r.choice("abcdefgh ") for _ in range(r.choice([3, 8, 330, 600]))) for _ in range(3000)]
    best = {}
    for _ in range(5):
        for name, make in (("hashes", lambda: [linededup.shingle_hashes(lines[k : k + 256]) for k in range(0, len(lines), 256)]), ("features", lambda: list(linededup.Matcher().features_of(lines)))):
            start = time.process_time()
            made = make()
            best[name] = min(best.get(name, 9e9), time.process_time() - start)
    assert all((f == linededup.Matcher().features(line)[0]).all() for (f, _), line in zip(made, lines, strict=True))
    assert best["features"] < 3.5 * best["hashes"]


def test_lines_against_all_pairs(spark, tmp_path):
    """Classes of lines are those of all pairs at 0.8; of a class the first line stays."""
    r, lines = random.Random(6), []
    for g in range(40):
        base = "".join(r.choice("abcdefghij klm") for _ in range(r.choice((3, 12, 30, 90))))
        for _ in range(r.randint(1, 6)):
            x = list(base)
            for _ in range(r.choice((0, 0, 1, 2))):
                x[r.randrange(len(x))] = r.choice("xyz")
            lines.append("".join(x))
    lines += ["A hot line, in every document"] * 60 + ["", "  ", "x", "X "]
    r.shuffle(lines)
    docs = [(k, "\n".join(lines[k * 5 : k * 5 + 5])) for k in range(-(-len(lines) // 5))] + [(-1, None)]
    got = {x.doc_id: x for x in linededup.line_dedup(table(spark, tmp_path / "d", docs)).collect()}
    # The order of lines is that of the file.
    order = [i for i, _ in [(x.doc_id, 0) for x in spark.read.parquet(str(tmp_path / "d")).collect()] if i >= 0]
    flat = [(d, k, t) for d in order for k, t in enumerate(dict(docs)[d].split("\n"))]
    sets = [set(linededup.shingle_hashes([linededup.canonical(t)])[0].tolist()) if t.strip() else None for *_, t in flat]
    root = list(range(len(flat)))
    for i in range(len(flat)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    gone = {}
    for k, (d, n, _) in enumerate(flat):
        if root[k] != k:
            gone.setdefault(d, []).append(n)
    assert {d: x.dropped for d, x in got.items() if x.dropped} == gone
    assert all(x.text == "\n".join(t for n, t in enumerate(dict(docs)[d].split("\n")) if n not in x.dropped) for d, x in got.items() if d >= 0) and got[-1].text is None


# Shared helpers ----------------------------------------------------------------------------------

def test_without(spark, tmp_path, monkeypatch):
    docs = table(spark, tmp_path / "d", [(k, str(k), k, k) for k in range(70_000)], "doc_id long, text string, row long, bits long", files=3)
    numbered = docs.withColumn("n", common.ordinal(docs))
    gone = numbered.where("doc_id % 7 = 0 or doc_id between 30000 and 40000").select(F.col("n").alias("row"))
    want = {k for k in range(70_000) if k % 7 and not 30_000 <= k <= 40_000}
    for most in (common.BITMAPS, 0):
        monkeypatch.setattr(common, "BITMAPS", most)
        left = common.without(docs, gone)
        assert {r.doc_id for r in left.collect()} == want and left.columns == docs.columns
    assert common.without(docs, gone.limit(0)).count() == 70_000


def test_scratch(spark):
    with common.scratch(spark):
        path = common.scratch_path(spark, "x")
        spark.range(3).write.parquet(path)
        outside = common.written(spark.range(2), "y", common.shared_dir(spark) + "/kept")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert outside.count() == 2
