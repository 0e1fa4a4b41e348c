"""Search through cells against the scan: equal results, what is opened, what is left out, recall with few probes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorescope.operators import cells, search

KIND = "id long, vector array<double>, metadata_type string"


def vectors(n, clusters, spread, seed=3, dim=16):
    r = np.random.default_rng(seed)
    c = r.standard_normal((clusters, dim))
    return c[r.integers(0, clusters, n)] + spread * r.standard_normal((n, dim))


def frame(spark, v):
    return spark.createDataFrame([(i, [float(a) for a in x], "columns" if i % 2 else "tables") for i, x in enumerate(v)], KIND).repartition(4)


def plain(df):
    return sorted(tuple(r) for r in df.select("query_id", "id", "rank", F.round("score", 9)).collect())


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    df = frame(spark, vectors(1200, 30, 0.15))
    return df, cells.build(df, str(tmp_path_factory.mktemp("cells") / "index"), n_cells=30)


def test_one_search_opens_few_cells(spark, clustered):
    df, index = clustered
    same = cells.opened(spark, index.path)
    for i in (0, 7, 500):
        q = df.filter(F.col("id") == i).first()["vector"]
        got = cells.nearest(spark, same, q, 10)
        want = search.top_k(df, q, 10)
        assert [r["id"] for r in got.collect()] == [r["id"] for r in want.collect()] and got.columns == want.columns
        files = cells.rows(spark, index).inputFiles()
        read = {f.split("cell=")[1].split("/")[0] for f in got.inputFiles()}
        assert len(read) <= 6 < len({f.split("cell=")[1].split("/")[0] for f in files})
        only = F.col("metadata_type") == "columns"
        assert [r["id"] for r in cells.nearest(spark, index, q, 10, only).collect()] == [r["id"] for r in search.top_k(df.filter(only), q, 10).collect()]
    none = cells.nearest(spark, index, q, 10, F.col("id") < 3)
    assert none.count() == 3


def test_all_pairs_leave_most_out(spark, clustered):
    df, index = clustered
    want = plain(search.all_similar(df, 5))
    for block in (64, 4096):
        found = cells.all_nearest(spark, index, 5, block=block)
        assert plain(found) == want
    assert cells.share_read(spark, index, found, 5) < 0.25


def test_a_large_cell_is_dealt_into_few_groups(spark, tmp_path):
    """One cell with all points: dealt out, with the scan's rows, and not once for each block of 4,096."""
    assert search.groups(76_923, 64, least=cells.CELL_GROUPS) == 3
    df = frame(spark, vectors(500, 4, 0.3))
    index = cells.build(df, str(tmp_path / "one"), n_cells=1)
    near = cells._scored(cells.rows(spark, index).select(F.col("id").alias("query_id"), "vector", "cell", F.array("cell").alias("targets")), cells.rows(spark, index), index, 3, True, 50)
    assert near.count() == 500 * 3 * cells.CELL_GROUPS  # the best of each group
    assert plain(cells.all_nearest(spark, index, 3, block=50)) == plain(search.all_similar(df, 3))


def test_few_probes_find_most(spark, clustered):
    df, index = clustered
    want = {t[:2] for t in plain(search.all_similar(df, 5))}
    got = {t[:2] for t in plain(cells.all_nearest(spark, index, 5, probes=3))}
    assert len(want & got) / len(want) >= 0.9


def test_spread_vectors_are_right_too(spark, tmp_path):
    v = np.random.default_rng(5).standard_normal((300, 12))
    v[10:120] = v[9]  # copies
    v[130:134] = 0
    df = frame(spark, v)
    odd = spark.createDataFrame([(900, None, "t"), (901, [1.0], "t"), (902, [None] * 12, "t")], KIND)
    index = cells.build(df.union(odd), str(tmp_path / "index"), n_cells=7)
    assert int(index.n.sum()) == 300 and index.n[-1] == 4
    assert plain(cells.all_nearest(spark, index, 4, block=32)) == plain(search.all_similar(df, 4))
    for i in (9, 50, 131, 250):
        q = [float(a) for a in v[i]]
        got, want = cells.nearest(spark, index, q, 8).collect(), search.top_k(df, q, 8).collect()
        assert [round(r["score"], 9) for r in got] == [round(r["score"], 9) for r in want] and [r["id"] for r in got] == [r["id"] for r in want]


def test_bounds_hold():
    """No point of a cell scores over the cell's bound."""
    x = search._matrix(pa.array(vectors(400, 8, 0.6).tolist()), 16)
    c = cells.centroids_of(x, 9)
    own = np.argmax(x @ c.T, axis=1)
    angle = np.arccos(np.clip((x * c[own]).sum(axis=1), -1, 1))
    low, high, n = (np.array([f(angle[own == k], initial=i) if f is not np.size else (own == k).sum() for k in range(9)] + [0]) for f, i in ((np.min, 9.0), (np.max, 0.0), (np.size, None)))
    index = cells.Index("", c, low, high, n)
    best = index.bounds(x)
    scores = x @ x.T
    assert all(scores[q, own == k].max(initial=-1) <= best[q, k] + 1e-12 for q in range(400) for k in range(9))
    assert (index.first(x, cells=2).sum(axis=1) == 2).all() and (index.first(x, points=1).sum(axis=1) == 1).all()


def test_nothing_to_index(spark, tmp_path):
    index = cells.build(frame(spark, np.zeros((0, 4))), str(tmp_path / "index"))
    assert cells.nearest(spark, index, [1.0], 5).count() == 0 == cells.all_nearest(spark, index).count()
    with pytest.raises(ValueError):
        cells.opened(spark, str(tmp_path / "none"))
