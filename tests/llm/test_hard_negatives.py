"""The scan against a plain comparison of every anchor with every row, and the query against its SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from lorescope.llm import hard_negatives as hard
from lorescope.llm.queries import ORACLES, QUERIES

KIND = "vec_id long, embedding array<float>, label int"


def brute(data, chosen, limit=5, share=80):
    """data: (id, whole vector, label). Repeated rows ask once."""
    out = []
    for a, x, label in sorted({(i, tuple(v), lab) for i, v, lab in data if chosen(i)}):
        scored = sorted((-int(np.dot(x, v)), i, lab) for i, v, lab in data if i != a)
        for s, p, lab in [t for t in scored if t[2] == label][:limit]:
            inside = [t for t in scored if t[2] != label and share * -s <= 100 * -t[0] <= 100 * -s][:limit]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(inside)]
    return sorted(out, key=repr)


def made(n=260, dim=12, seed=2, labels=3):
    r = np.random.default_rng(seed)
    v = np.round(r.standard_normal((n, dim)) * np.linspace(2, 0.1, dim), 2).astype("f4") + np.float32(0.5)
    v[20:100] = v[3]  # copies
    lab = np.where(np.arange(n) % 3 < 2, 0, r.integers(0, labels, n))  # one label has two thirds
    return [(i, v[i].tolist(), int(lab[i])) for i in range(n)]


def whole(data):
    return [(i, np.floor(256.0 * np.array(v, "f4").astype("f8")).astype("i8").tolist(), lab) for i, v, lab in data]


@pytest.mark.parametrize("block_rows", [7, 64, 2048])
def test_scan(spark, block_rows):
    data = made()
    df = spark.createDataFrame(data, KIND).repartition(3)
    want = brute(whole(data), lambda i: i % 10 == 0)
    assert rows(hard.mined(df, F.col("id") % 10 == 0, block_rows=block_rows)) == want
    assert len(want) > 300


def test_blocks_of_anchors_and_groups(spark, monkeypatch):
    """More blocks of anchors than one, and groups of several blocks of rows."""
    data = made(300)
    df = spark.createDataFrame(data, KIND).repartition(4)
    plain = hard.scan
    monkeypatch.setattr(hard, "scan", lambda *a, **b: plain(*a, **b, anchor_rows=5, groups=3))
    want = brute(whole(data), lambda i: i % 9 == 0, 3, 50)
    assert rows(hard.mined(df, F.col("id") % 9 == 0, limit=3, floor_share=50, block_rows=16)) == want and want


def test_awkward_rows(spark):
    good = made(120, 4, 5)
    odd = [(None, [1.0] * 4, 1), (500, None, 1), (501, [1.0] * 4, None), (502, [None, 1.0, 1.0, 1.0], 1), (503, [float("nan")] * 4, 1), (504, [float("inf")] * 4, 0), (505, [1.0] * 3, 0), (506, [1e30] * 4, 0), (600, [], 1)]
    same_id = [(10, good[50][1], good[50][2]), (10, good[10][1], good[10][2]), (20, [0.25] * 4, 2)]  # another vector, a repeated row, another label
    df = spark.createDataFrame(good + odd + same_id, KIND).repartition(3)
    want = brute(whole(good + same_id), lambda i: i % 10 == 0)
    assert rows(hard.mined(df, F.col("id") % 10 == 0)) == want
    clash = df.withColumns({c: F.lit("clash") for c in ("id", "vector", "anchor", "block", "windows", "i", "g", "score", "x", "n")})
    assert rows(hard.mined(clash, F.col("id") % 10 == 0)) == want
    assert hard.mined(df.limit(0), F.col("id") % 10 == 0).count() == 0 == hard.mined(df, F.col("id") == -1).count()
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], KIND)
    assert hard.mined(alone, F.col("id") == 0).count() == 0


def test_large_numbers_stay_exact(spark):
    """Products over 2^53."""
    r = np.random.default_rng(8)
    data = [(i, (r.integers(0, 2**24, 6) / 64).tolist(), i % 2) for i in range(60)]
    df = spark.createDataFrame(data, KIND)
    want = brute(whole(data), lambda i: i % 6 == 0)
    assert max(w[4] for w in want) > 2**53 and rows(hard.mined(df, F.col("id") % 6 == 0, block_rows=16)) == want


def test_bounds_leave_rows_unread():
    """With a few long dimensions most rows go before the last dimension; results are those of a full product."""
    r = np.random.default_rng(1)
    x = np.floor(r.standard_normal((3000, 64)) * 2.0 ** -np.arange(64) * 4096).astype("i8")
    ids, labels = np.arange(3000), r.integers(0, 4, 3000)
    scan = hard._Scan(ids[:20], labels[:20], x[:20], True, [np.array([[-(2**62), 2**62]])] * 20, 5)
    for k in range(0, 3000, 500):
        part = x[k : k + 500]
        scan.block(ids[k : k + 500], labels[k : k + 500], part.T, part.min(axis=0), part.max(axis=0))
    for k in range(20):
        score = x @ x[k]
        want = sorted((-score[i], i) for i in ids if labels[i] == labels[k] and i != k)[:5]
        assert list(zip(-scan.best[k][0][1], scan.best[k][0][0])) == want
    assert scan.looked < 0.15 * scan.read


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '/root/testdata/{sf}/embeddings.parquet'")
    got = QUERIES["op11_hard_negatives"](spark, f"/root/testdata/{sf}")
    assert rows(got) == sorted(con.execute(ORACLES["op11_hard_negatives"]).fetchall(), key=repr)
    assert got.count() > 10
