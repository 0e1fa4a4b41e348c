"""Near copies in the pipeline's stage against a plain count of all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import SCHEMA, awkward, prose

import corpus_pipeline
from lorescope.llm import near_copies, simhash


def plain_set(text) -> frozenset:
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_kept(texts: dict) -> set:
    sets = {d: plain_set(t) for d, t in texts.items()}
    top, ids = {d: d for d in texts}, sorted(texts)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or (5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 9 * len(x & y) >= 4 * (len(x) + len(y))):
                low, high = sorted((find(a), find(b)))
                top[high] = low
    return {d for d in ids if find(d) == d}


def stage(spark, docs):
    return [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()]


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = stage(spark, docs)
    assert len(kept) == len(set(kept)) and set(kept) == plain_kept({r["doc_id"]: r["text"] for r in docs.collect()})
    assert not {944, 875, 770} & set(kept)


def test_chains_and_pairs_below(spark):
    """Documents in a chain with 0.8 to 1 between neighbours, and families whose members lie around 0.8."""
    texts, words = {}, prose(1, 300).split()
    for i in range(40):
        texts[i] = " ".join(words)
        words[7 * i] = f"changed{i}"
    for f in range(20):
        base = prose(50 + f, 200).split()
        for m in range(6):
            own = list(base)
            for j in range(f // 2):
                own[(17 * j + 31 * m) % 200] = f"own{m}x{j}"
            texts[1000 + 10 * f + m] = " ".join(own)
    texts |= {2000: "", 2001: None, 2002: "a b c", 2003: "A b  c", 2004: "a b d"}
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in texts.items()], SCHEMA)
    assert sorted(stage(spark, docs)) == sorted(plain_kept(texts))


def test_one_row_of_each_group_stays(spark):
    """Null texts and blank ones are alike; rows without an id and repeated rows are rows like others."""
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, awkward(spark), "").collect()
    ids = [r["doc_id"] for r in kept]
    assert None in ids and ids.count(8) == 1 and 2 not in ids and 1 in ids and 3 in ids and 4 not in ids and 5 not in ids
    twins = spark.createDataFrame([(None, prose(4, 90), "en", "a", 1)] * 5 + [(7, prose(5, 90), None, None, None)] * 3 + [(None, prose(5, 90), "x", "y", 2)], SCHEMA)
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, twins.repartition(4), "").collect()
    assert sorted((r["doc_id"], r["lang"]) for r in kept if r["doc_id"]) == [(7, None)] and len(kept) == 2


def test_names_that_clash(spark):
    docs = awkward(spark)
    for c in ("__gone", "rid", "best", "top", "keys", "n", "shingles", "rows"):
        docs = docs.withColumn(c, F.lit("clash"))
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert out.columns == docs.columns and out.count() == dict(corpus_pipeline.STAGES)["near_dedup"](spark, awkward(spark), "").count()


@pytest.mark.parametrize("block", [4, 512])
def test_sets_are_compared_in_blocks(spark, block):
    """A hub of 60 sets, and pairs around it that only their own tests can link."""
    rng = np.random.default_rng(2)
    base = list(range(100))
    data = {i: sorted({*rng.permutation(base)[: rng.integers(80, 100)].tolist(), *rng.integers(200, 10_000, rng.integers(0, 12)).tolist()}) for i in range(60)}
    sets = spark.createDataFrame(list(data.items()), "fp long, shingles array<int>")
    keys = spark.createDataFrame([(i, 0, 1, r, i) for i in data for r in (0, 1)], "fp long, start int, key long, role int, top long")
    tops = {r["node"]: r["top"] for r in simhash.components(near_copies.tested(keys, sets, block)).collect()}
    found, want = {}, {}
    for i in data:
        found.setdefault(tops.get(i, i), set()).add(i)
    top = {i: i for i in data}
    for _ in data:
        for i, x in data.items():
            for j, y in data.items():
                if 9 * len(set(x) & set(y)) >= 4 * (len(x) + len(y)):
                    top[i] = top[j] = min(top[i], top[j])
    for i, t in top.items():
        want.setdefault(t, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values())) and len(want) > 1


def test_ranges_of_values_give_the_same_counts():
    r = np.random.default_rng(4)
    base = r.integers(-(2**31), 2**31, 3000)
    sets = [np.unique(np.where(r.random(3000) < p, base, r.integers(-(2**31), 2**31, 3000))).astype("i4") for p in (1, 0.99, 0.93, 0.9, 0.5, 0)] + [np.array([], "i4"), np.array([-(2**31), 2**31 - 1], "i4")]
    lists = pa.array([s.tolist() for s in sets], pa.list_(pa.int32()))
    want = [[len(np.intersect1d(a, b)) * 5 >= 4 * len(np.union1d(a, b)) for b in sets] for a in sets]
    for at_once in (100, 5000, 10**9):
        assert near_copies.similar(lists, lists, at_once).tolist() == want


def test_a_unit_of_long_sets_stays_small():
    """128 x 128 sets of 100,000 shingles: beside the sets, a fixed number of values at a time."""
    import tracemalloc

    r = np.random.default_rng(4)
    flat = r.integers(-(2**31), 2**31, 128 * 100_000).astype("i4")
    lists = pa.ListArray.from_arrays(pa.array(np.arange(129) * 100_000, "i4"), pa.array(flat))
    tracemalloc.start()
    near_copies.similar(lists, lists)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6


def test_long_sets_are_dealt_into_more_blocks(spark):
    """Sets that weigh as much as a block alone are in different units, and no link is lost."""
    r = np.random.default_rng(9)
    base = r.integers(-(2**31), 2**31, 400)
    sets = [np.unique(np.where(r.random(400) < 0.97, base, r.integers(-(2**31), 2**31, 400))).tolist() for _ in range(12)]
    frame = spark.createDataFrame([(i + 1, s) for i, s in enumerate(sets)], "fp long, shingles array<int>")
    keys = spark.createDataFrame([(i + 1, 0, 5, role, i + 1) for i in range(12) for role in (0, 1)], "fp long, start int, key long, role int, top long")
    heavy = spark.createDataFrame([(i + 1, 4) for i in range(12)], "fp long, weight int")
    found = {}
    for long in (None, heavy):
        edges = [tuple(e) for e in near_copies.tested(keys, frame, 8, long).collect()]
        found[long is None] = {frozenset(r) for r in [tuple(x) for x in near_copies.simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()]}
    assert {min(x) for x in found[True]} == {min(x) for x in found[False]} == {1} and len(set().union(*found[True])) == 12 == len(set().union(*found[False]))
    units = near_copies.simhash.dealt(keys.join(heavy, "fp"), 8).select("i", "j").distinct().count()
    assert units > near_copies.simhash.dealt(keys, 8).select("i", "j").distinct().count()


@pytest.mark.parametrize("most", [1, 2, 1 << 16])
def test_rows_that_go_are_taken_out_where_they_lie(spark, most, tmp_path):
    rids = [(p << 40) + k for p in range(3) for k in (0, 1, 63, 64, 4095, 4096, 9000, 20000)]
    spark.createDataFrame([(r, (r, None if r % 2 else "x")) for r in rids], "rid long, row struct<rid: long, text: string>").coalesce(1).write.parquet(str(tmp_path / "rows"))
    sketches = spark.read.parquet(str(tmp_path / "rows"))
    for drop in ([], rids[::2], rids[:8], rids):
        out = near_copies.without(sketches, spark.createDataFrame([(r,) for r in drop], "rid long"), most)
        assert sorted(r["rid"] for r in out.collect()) == sorted(set(rids) - set(drop))
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert near_copies.slices([(1, 2), (4, 1), (5, 3), (9, 1)], 3) == [5, 9]
