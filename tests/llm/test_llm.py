"""Small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tracemill.llm import ann, bytebpe, exactdedup, langid, linededup, materialise, neardedup, packing, pii, queries, sharding, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, shard int, kept boolean"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    base = prose(1)
    near = base.split()
    near[50] = "changed"
    texts = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, prose(6, 30000)), (7, prose(7)), (7, prose(7)), (None, prose(8)), (9, "a.b@c.com 你好 é"), (10, "...")]
    rows = [(i, t, "en", "s", 0, 5, 5, True) for i, t in texts]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def empty(docs):
    return docs.where("doc_id = -1")


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == docs.count() and sharding.shard(empty, 4).count() == 0
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_exact_dedup(docs, empty):
    rows = exactdedup.exact_dedup(docs).collect()
    assert len(rows) == docs.count() and exactdedup.exact_dedup(empty).count() == 0
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows if r.doc_id in (1, 2, 4, 5)} == {1: (2, 2, False), 2: (2, 2, True), 4: (5, 2, False), 5: (5, 2, True)}
    assert sum(r.kept for r in rows) == docs.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_near_dedup(docs, empty):
    rows = neardedup.near_dedup(docs).collect()
    assert len(rows) == docs.count() and neardedup.near_dedup(empty).count() == 0
    of = {r.doc_id: (r.class_id, r.kept) for r in rows}
    assert of[1] == (1, True) and of[2] == (1, False) and of[3] == (1, False)
    assert of[4][1] and of[5][1] and of[6][1] and of[None][1] and sum(r.kept for r in rows if r.doc_id == 7) == 1


def test_near_dedup_sends_python_workers_small_batches(spark, tmp_path, monkeypatch):
    seen, plain = [], neardedup.frequencies

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    def frequencies(numbered):
        seen.extend(numbered.mapInArrow(sizes, "n long, bytes long").collect())
        return plain(numbered)

    monkeypatch.setattr(neardedup, "frequencies", frequencies)
    spark.range(0, 6_000, 1, 1).selectExpr("id AS doc_id", "repeat('abcdefgh ', 500) AS text").write.parquet(str(tmp_path / "d"))
    rows = neardedup.near_dedup(spark.newSession().read.parquet(str(tmp_path / "d"))).collect()
    assert len(rows) == 6_000 and [r.doc_id for r in rows if r.kept] == [0]
    assert sum(r.n for r in seen) == 6_000 and sum(r.bytes for r in seen) > 27_000_000 and max(r.bytes for r in seen) < 5 << 20


@pytest.mark.parametrize("text_bytes", [16_384, 8])
def test_near_dedup_against_brute_force(spark, tmp_path, monkeypatch, text_bytes):
    from tracemill.llm import matching

    # As if texts were long: the smallest groups and blocks.
    monkeypatch.setattr(matching, "TEXT_BYTES", text_bytes)
    r, rows = random.Random(3), []
    for g in range(12):
        base = prose(100 + g, 80).split()
        for _ in range(8):
            words = list(base)
            for _ in range(r.randint(0, 5)):
                words[r.randrange(80)] = f"new{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found = {x.doc_id: x.class_id for x in neardedup.near_dedup(spark.read.parquet(str(tmp_path / "d"))).collect()}
    from tracemill.llm.matching import weighted_jaccard

    make = neardedup.Features(*neardedup.frequencies(spark.read.parquet(str(tmp_path / "d")).select("text")))
    feats, root = [make(neardedup.words_of(t)) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if weighted_jaccard(feats[i], feats[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert [found[i] for i in range(len(rows))] == root


def test_packing(docs, empty):
    rows = packing.pack(docs, capacity=64).collect()
    assert packing.pack(empty).count() == 0
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 64
    assert {(r.start, r.length) for r in rows if r.doc_id in (4, 5)} == {(0, 1)}


def test_tokens_match_the_libraries():
    r = random.Random(0)
    chars = [chr(c) for c in range(1, 0x250)] + list("日本語кирΣß’é😀́　 '\n")
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 50))) for _ in range(400)] + ["İΣ <|endoftext|>", ""]
    words = tokens.word_ids()
    direct = [np.array(e.ids, "<u4").tobytes() for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert words.batch(texts) == direct
    bpe = tokens.byte_bpe()
    ranks = tokens.read_ranks(public_tokenizers.path(tokens.BYTE_FILE))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = bpe.batch(texts)
    assert ids == [own.encode_ordinary(t) for t in texts] and [bpe.decode(i) for i in ids] == [t.encode() for t in texts]
    assert all(b >= a for t, i in zip(texts, ids, strict=True) for a, b in bpe.spans(t, i))


def test_words_by_arrays(monkeypatch):
    """Contractions, long words and texts cut at white space give the library's ids; words kept are encoded once."""
    monkeypatch.setattr(tokens, "WORDS_KEPT", 1 << 6)
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 256)
    r = random.Random(3)
    texts = ["".join(r.choice("'strevmdlS9!²é  ") for _ in range(r.randint(0, 900))) for _ in range(300)]
    texts += ["a" * n + " it's 'some" for n in (63, 64, 65, 3000)] + ["a\u0085b\x1cc''s", "", "'"]
    words = tokens.WordIds(public_tokenizers.path(tokens.WORD_FILE))
    assert words.by_array
    direct = [np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words.batch(texts) == words.batch(texts) == direct and words.store.n == 1 << 6
    monkeypatch.undo()
    words, sent, encode = tokens.WordIds(public_tokenizers.path(tokens.WORD_FILE)), [], tokens.WordIds._encode
    monkeypatch.setattr(tokens.WordIds, "_encode", lambda self, some: (sent.extend(some), encode(self, some))[1])
    assert words.batch(texts) == direct
    seen = {w for w in sent if len(w) <= tokens.HASHED_CHARS}
    assert len(seen) == sum(len(w) <= tokens.HASHED_CHARS for w in sent) == words.store.n
    words.by_array = False
    assert words.batch(texts) == direct


def test_byte_bpe(docs, empty):
    rows = {r.doc_id: r for r in bytebpe.round_trip_digests(docs).collect()}
    assert rows[4].n_tokens == rows[5].n_tokens == 0 and bytebpe.round_trip_digests(empty).count() == 0
    back = {r.doc_id: bytes(r.data) for r in bytebpe.decode(bytebpe.encode(docs, offsets=True)).collect()}
    assert back[9] == "a.b@c.com 你好 é".encode() and back[4] == b""


def test_training_order(docs, empty):
    n = 1000
    assert sorted(materialise.feistel(np.arange(n), n, 5)) == list(range(n))
    path, index = materialise.materialise(docs, length=32, shard_sequences=16)
    slots = sorted(r.slot for r in index.collect())
    read = {r.slot: bytes(r.data) for r in materialise.read_shards(docs.sparkSession, path).collect()}
    assert slots == list(range(len(slots))) == sorted(read) and all(len(d) == 64 and d[-2:] == b"\0\0" for d in read.values())
    assert materialise.materialise(empty)[1].count() == 0


def test_language(spark, docs):
    r = random.Random(2)
    word = lambda letters: "".join(r.choice(letters) for _ in range(5))
    rows = [(i, " ".join(word("abcde" if i % 2 else "vwxyz") for _ in range(30)), "l1" if i % 2 else "l2") for i in range(80)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels, made = langid.fit(train)
    assert all(x.lang == x.lang_pred for x in langid.predict(train, labels, made, keep=("doc_id", "lang")).collect())
    und = {x.doc_id: (x.lang_pred, x.score) for x in langid.predict(docs, labels, made).collect()}
    assert und[4] == und[5] == und[10] == ("und", 0.0)


def test_pii(docs, empty, spark):
    x = spark.createDataFrame([(1, "Mr. John Smith, a.b@c.com, +1 (216) 555-4155 or 216-555-4155; card 4493759588808516", 3), (2, "A.B@c.com again", 3)], "doc_id long, text string, entities int")
    one, two = sorted(pii.pseudonymise(x, key="k").collect(), key=lambda r: r.record.doc_id)
    mail = [e.surrogate for e in one.entities if e.kind == "email"]
    assert [m.lower() for m in mail] == [e.surrogate.lower() for e in two.entities] and "555-4155" not in one.text and "Smith" not in one.text and "4493759588808516" not in one.text
    assert {r.record.doc_id: r.text for r in pii.pseudonymise(docs, key="k").collect()}[4] is None and pii.pseudonymise(empty, key="k").count() == 0
    many = spark.range(300).select(F.lit("ssn").alias("kind"), F.format_string("%09d", "id").alias("entity"))
    made = pii.surrogates(many, "k").collect()
    assert len({r.made for r in made}) == 300 and not {r.made for r in made} & {r.entity for r in made}


def test_pii_quoted_key(spark):
    x = spark.createDataFrame([(1, '{"api_key": "s3cretvalue1", "password" : "hunter2hunter", "id": "plainvalue"}')], "doc_id long, text string")
    got = pii.pseudonymise(x, key="k").first()
    assert [e.kind for e in got.entities] == ["secret", "secret"] and "s3cretvalue1" not in got.text and "hunter2hunter" not in got.text
    assert got.text.startswith('{"api_key": "') and got.text.endswith('", "id": "plainvalue"}')


def test_lines(spark, docs, empty, tmp_path):
    line = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(1, f"{line}\nshort\n\nshort"), (2, f"another line that nobody else has\n{line.replace('today', 'todax')}"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: (r.text, r.dropped) for r in linededup.line_dedup(spark.read.parquet(str(tmp_path / "d"))).collect()}
    # Equal lines go whatever their length; ``min_chars`` leaves short ones alone.
    assert got[1] == (f"{line}\nshort\n", [3]) and got[2] == ("another line that nobody else has", [1]) and got[3][0] is None and got[4] == ("", [])
    assert linededup.line_dedup(spark.read.parquet(str(tmp_path / "d")), min_chars=16).where("doc_id = 1").first().text == rows[0][1]
    assert linededup.line_dedup(docs).count() == docs.count() and linededup.line_dedup(empty).count() == 0


def test_short_lines(spark, tmp_path):
    """All but blank lines take part: copies of any length go, and short lines much alike."""
    (tmp_path / "sf").mkdir()
    rows = [(1, "Menu\n\nx\nread more now\nmenu2\n "), (2, " menu\n\nX\nread more now!\nmenu3\nread less now\n ")]
    path = str(tmp_path / "sf" / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    got = {r.doc_id: r.dropped for r in queries.op10_lines(spark, str(tmp_path / "sf")).collect()}
    assert got == {1: [], 2: [0, 2, 3]}


def test_bins_of_short_lines():
    """Bins agree as often as the similarity says, also for lines of few shingles."""
    rng = np.random.default_rng(0)
    lines = ["".join(rng.choice(list("abcdefghij"), 12)) for _ in range(2000)]
    equal = (linededup.bins(lines) == linededup.bins([x + "k" for x in lines])).sum(axis=1)  # five of six shingles
    assert equal.min() >= 32


def test_lines_candidates():
    """Of pairs at similarity 0.8 to 0.82 fewer than 2 in 1,000 share no band."""
    rng = np.random.default_rng(1)
    lines = ["".join(rng.choice(list("abcdefghij"), 80)) for _ in range(4000)]
    near = [x + "".join(rng.choice(list("abcdefghij"), 17)) for x in lines]  # 73 of 90 shingles
    one, two = (linededup.band_keys(linededup.bins(x)) for x in (lines, near))
    assert (~(one == two).any(axis=1)).sum() < 8


def test_nearest(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 16)))]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, rows[0][1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    x = np.array([v for i, v in rows if i < 300 or i == 304])
    ids = np.array([*range(300), 304])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.search(e, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q in range(0, 300, 50):
        score = unit @ unit[q]
        score[q] = -9
        hits += len(set(ids[np.argsort(-score)[:5]]) & set(got[q]))
    assert got[0][0] == 304 and hits >= 27 and 300 not in got
    assert ann.search(e.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0
    assert zlib.crc32(b"") == 0


def test_nearest_in_a_large_group(spark, tmp_path):
    """More near copies than candidates: the five nearest are those of brute force, copies by the smaller id."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16))
    x[:600] = x[0] + 0.02 * rng.normal(size=(600, 16))
    x[600:640] = x[600]
    spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    got = {}
    for r in ann.search(e, F.col("vec_id") % 50 == 0, rerank=20, query_block=7, levels=2, words=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 900, 50):
        score = np.round(unit @ unit[q], 12)
        score[q] = -9
        assert got[q] == np.lexsort((np.arange(900), -score))[:5].tolist()
