"""Links between similar texts, from the bands of their signatures.

``reps`` lists texts by number (row) with their band keys; ``numbered`` gives the
texts.  A matcher, sent to the executors, says how two texts compare: its
``features`` (hashes in order, weights or None for 1 each), ``features_of`` (the
same of many texts), ``similarity``, and the ``cells`` of a text's sketch.

A sketch sums a text's weights by cell of their hashes.  What two texts have in
common weighs no more than the lesser weight of every cell, so that pairs whose
sketches stay below the similarity need no comparison, and none above is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, written
from .graph import components

#: Texts compared with one leader in one task.
GROUP_ROWS = 256
#: Texts of one side of a block comparison.
BLOCK_ROWS = 512
#: Texts in one task's group, about.
BIN_ROWS = 2_000
#: Bytes of a text for which these numbers are meant; of longer ones fewer are taken together.
TEXT_BYTES = 16_384
#: Texts of one side of a block, however long they are.
LEAST_ROWS = 8
#: Band keys for each task, about, and of one task that are looked at together.
KEYS_A_TASK = 1 << 22
KEYS_HELD = 1 << 22
#: Cells of sketches compared at a time.
COMPARED = 1 << 21
#: Cells of a sketch that are one in a coarse one.
COARSE = 8
#: What rounding of sketches can do, at most.
ROUNDING = 1 - 1e-5


def weighted_jaccard(x: tuple[np.ndarray, np.ndarray | None], y: tuple[np.ndarray, np.ndarray | None]) -> float:
    if x[1] is None and y[1] is None:
        both = np.sort(np.concatenate([x[0], y[0]]))
        common = np.count_nonzero(both[1:] == both[:-1])
        return float(common / (len(both) - common)) if len(both) else 0.0
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    common = np.minimum(x[1][i], y[1][j]).sum()
    union = x[1].sum() + y[1].sum() - common
    return float(common / union) if union else 0.0


def _links(out: list[tuple[int, int, float]]) -> pa.Table:
    a, b, similarity = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(similarity, pa.float64())})


LINKS = "a long, b long, similarity double"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, row, first) of the keys that several rows have.  Of keys seen before only one row each is
    kept, so that memory is bounded by the distinct keys of a task, however often one comes."""
    known, firsts, told = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def found(keys, rows):
        nonlocal known, firsts, told
        order = np.argsort(keys)
        keys, rows = keys[order], rows[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.append(start, len(keys)))
        own, at = keys[start], np.searchsorted(known, keys[start])
        old = np.zeros(len(own), bool)
        old[at < len(known)] = known[at[at < len(known)]] == own[at < len(known)]
        first = np.minimum.reduceat(rows, start)
        first[old] = firsts[at[old]]
        late = at[old][~told[at[old]]]
        several = np.repeat(old | (count > 1), count)
        out = [np.concatenate(x) for x in ((keys[several], known[late]), (rows[several], firsts[late]), (np.repeat(first, count)[several], firsts[late]))]
        told[late] = True
        known, firsts, told = (np.insert(x, at[~old], y[~old]) for x, y in ((known, own), (firsts, first), (told, count > 1)))
        return pa.RecordBatch.from_arrays(list(map(pa.array, out)), names=["key", "row", "first"])

    some, n = [], 0
    for batch in batches:
        some.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= KEYS_HELD:
            yield found(*map(np.concatenate, zip(*some, strict=True)))
            some, n = [], 0
    if n:
        yield found(*map(np.concatenate, zip(*some, strict=True)))


def buckets_of(reps: DataFrame) -> DataFrame:
    """(key, row, first): the rows of every band key that several of ``reps`` have, and one of them, written.

    Keys are shuffled once; a task tells at once which come again.
    """
    spark = reps.sparkSession
    keys = reps.select(F.explode("bands").alias("key"), "row")
    n = reps.agg(F.sum(F.size("bands"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // KEYS_A_TASK))
    return written(keys.repartition(tasks, "key").mapInArrow(_shared, "key long, row long, first long"), "buckets")


def _scale(texts: DataFrame) -> int:
    """By how much fewer texts than for ``TEXT_BYTES`` are taken together."""
    return max(1, int((texts.agg(F.avg(F.octet_length("text"))).first()[0] or 0) / TEXT_BYTES))


def verify(edges: DataFrame, texts: DataFrame, matcher, scale: int = 1) -> DataFrame:
    """The edges (a, b) of at least the matcher's similarity, with it.

    Texts meet the leader ``a`` in groups of ``GROUP_ROWS``; a leader with more
    is sent to as many groups.  A task's bin holds about ``BIN_ROWS`` texts of
    many groups.
    """
    edges = written(edges, "edges")
    bins = max(1, -(-edges.count() * scale // BIN_ROWS))
    group_rows = max(LEAST_ROWS, GROUP_ROWS // scale)
    # Written, so that the join below is of two plain exchanges and Spark can split a leader of very many edges.
    groups = sized(edges.groupBy("a").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("groups")), "leaders")
    members = (
        edges.join(groups, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "groups").cast("int"))
        .select("a", "salt", F.col("b").alias("row"), F.lit(1).alias("role"))
    )
    leaders = groups.select(
        "a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.col("a").alias("row"), F.lit(0).alias("role")
    )

    def compare(table: pa.Table) -> pa.Table:
        how, out = matcher.value, []
        table = table.sort_by([("a", "ascending"), ("salt", "ascending"), ("role", "ascending")])
        group, leader = None, None
        listed = zip(*(table.column(c).to_pylist() for c in ("a", "salt", "role", "row")), strict=True)
        found = how.features_of(text.as_py() for text in table.column("text"))
        for (a, salt, role, row), features in zip(listed, found, strict=True):
            if not role:
                group, leader = (a, salt), features
            elif group == (a, salt):
                similarity = weighted_jaccard(leader, features)
                if similarity >= how.similarity:
                    out.append((a, row, similarity))
        return _links(out)

    met = members.union(leaders).join(texts, "row").select(
        F.pmod(F.xxhash64("a", "salt"), F.lit(bins)).alias("bin"), "a", "salt", "role", "row", "text"
    )
    return written(met.groupBy("bin").applyInArrow(compare, LINKS), "verified")


def sketches(features, cells: int) -> np.ndarray:
    """Weight of each text's features by cell of their hashes (texts, cells)."""
    shift = np.uint64(64 - (cells - 1).bit_length())
    made = [np.bincount((hashes >> shift).astype(np.int64), weights, cells).astype(np.float32) for hashes, weights in features]
    return np.stack(made) if made else np.zeros((0, cells), np.float32)


def may_reach(sketch: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs (i, j) the sketches leave at ``similarity`` or more."""
    total = sketch.sum(axis=1, dtype=np.float64)
    least = similarity / (1 + similarity) * ROUNDING * (total[i] + total[j])
    at = np.flatnonzero(np.minimum(total[i], total[j]) >= least)
    for table in (sketch.reshape(len(sketch), -1, COARSE).sum(axis=2), sketch):
        step, kept = max(1, COMPARED // table.shape[1]), []
        for start in range(0, len(at), step):
            some = at[start : start + step]
            common = np.minimum(table[i[some]], table[j[some]]).sum(axis=1)
            kept.append(some[common >= least[some]])
        at = np.concatenate(kept) if kept else at
    out = np.zeros(len(i), bool)
    out[at] = True
    return out


def _compare_blocks(matcher):
    def unit(how, at: range, rows, left, labels, bands, sketch, held, band_key, out: list) -> None:
        """Compare the texts of one unit of blocks; ``held`` has the features of the texts of the task by place."""
        lo, hi = at.start, at.stop
        band = int(np.flatnonzero(bands[lo] == band_key)[0])
        root = {labels[k]: labels[k] for k in at}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        sides = left[lo:hi]
        one_block = sides.all()
        lefts, right = lo + np.flatnonzero(sides), np.arange(lo, hi) if one_block else lo + np.flatnonzero(~sides)
        label, step = np.array(labels[lo:hi]), max(1, (1 << 18) // max(1, len(right)))
        for start in range(0, len(lefts), step):
            some = lefts[start : start + step]
            apart = label[some - lo, None] != label[None, right - lo]
            if one_block:
                apart &= right > some[:, None]
            k_of, j_of = np.nonzero(apart)
            k_of, j_of = some[k_of], right[j_of]
            fresh = ~(bands[k_of, :band] == bands[j_of, :band]).any(axis=1)
            k_of, j_of = k_of[fresh], j_of[fresh]
            near = may_reach(sketch[lo:hi], k_of - lo, j_of - lo, how.similarity)
            for k, j in zip(k_of[near].tolist(), j_of[near].tolist(), strict=True):
                a, b = find(labels[k]), find(labels[j])
                if a != b:
                    similarity = weighted_jaccard(held(k), held(j))
                    if similarity >= how.similarity:
                        root[a] = b
                        out.append((*sorted((int(rows[k]), int(rows[j]))), similarity))

    def run(table: pa.Table) -> pa.Table:
        how, out = matcher.value, []
        table = table.sort_by([(c, "ascending") for c in ("key", "i", "kind", "j", "row")])
        texts, labels = table.column("text").to_pylist(), table.column("label").to_pylist()
        rows, left = table.column("row").to_numpy(), table.column("left").to_numpy(zero_copy_only=False)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        sketch, held = sketches(how.features_of(texts), how.cells), lru_cache(1024)(lambda k: how.features(texts[k]))
        unit_of = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "kind", "j")])
        starts = [0, *(np.flatnonzero((unit_of[:, 1:] != unit_of[:, :-1]).any(axis=0)) + 1).tolist()]
        for lo, hi in zip(starts, [*starts[1:], len(rows)], strict=True):
            unit(how, range(lo, hi), rows, left, labels, bands, sketch, held, unit_of[0, lo], out)
        return _links(out)

    return run


def links_apart(buckets: DataFrame, reps: DataFrame, links: DataFrame, texts: DataFrame, matcher, scale: int = 1) -> DataFrame:
    """Further links within buckets (key, row) whose rows are in several components of ``links``."""
    block_rows = max(LEAST_ROWS, BLOCK_ROWS // scale)
    labels = sized(components(links.select("a", "b")).withColumnRenamed("node", "row"), "labels")
    rows = written(buckets.join(labels, "row", "left").select("key", "row", F.coalesce("label", "row").alias("label")), "bucket_rows")
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    whole = (
        sizes.groupBy("key")
        .agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("in_main"), F.sum("n").alias("n"))
        # Two documents apart have been compared already.
        .where("n > in_main and n > 2")
        .select("key", "main", F.ceil((F.col("n") - F.col("in_main")) / block_rows).cast("int").alias("outs"), F.ceil(F.col("in_main") / block_rows).cast("int").alias("mains"))
    )
    whole = sized(whole, "apart")
    split = rows.join(whole, "key").withColumn("out", F.col("label") != F.col("main"))
    split = split.withColumn("block", F.pmod(F.xxhash64("row"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("mains"))).cast("int"))
    outer = """
        concat(transform(sequence(block, outs - 1), j -> named_struct('i', block, 'kind', 0, 'j', j, 'left', true)),
               transform(sequence(0, mains - 1), j -> named_struct('i', block, 'kind', 1, 'j', j, 'left', true)),
               transform(filter(sequence(0, block), i -> i < block), i -> named_struct('i', i, 'kind', 0, 'j', block, 'left', false)))"""
    inner = "transform(sequence(0, outs - 1), i -> named_struct('i', i, 'kind', 1, 'j', block, 'left', false))"
    units = written(
        split.select("key", "row", "label", F.explode(F.expr(f"if(out, {outer}, {inner})")).alias("unit")).select("key", "row", "label", "unit.*"),
        "units",
    )
    if units.isEmpty():
        return links
    some = sized(units.select("row").distinct(), "rows")
    texts = texts.join(some, "row", "left_semi").join(reps.join(some, "row", "left_semi"), "row")
    bins = max(1, -(-units.count() * scale // BIN_ROWS))
    of = F.pmod(F.xxhash64("key", "i", "kind", "j"), F.lit(bins)).alias("bin")
    met = units.join(texts, "row").select(of, "key", "i", "kind", "j", "row", "left", "label", "bands", "text")
    more = met.groupBy("bin").applyInArrow(_compare_blocks(matcher), LINKS)
    return written(links.union(more), "links")


def candidate_links(reps: DataFrame, numbered: DataFrame, matcher) -> DataFrame:
    """Verified links (a, b, similarity) among ``reps`` (row, bands; written) that make up the classes."""
    buckets = buckets_of(reps)
    met = sized(buckets.select("row").distinct(), "rows")
    texts = written(numbered.join(met, "row", "left_semi"), "texts")
    edges = buckets.where("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b")).distinct()
    scale = _scale(texts)
    return links_apart(buckets, reps, verify(edges, texts, matcher, scale), texts, matcher, scale)
