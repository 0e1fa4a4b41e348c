"""Components against numpy's, whitened rows against plain sums over the whole list, and awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorescope.llm import whitening
from lorescope.llm.queries import QUERIES

KIND = "vec_id long, embedding array<float>, label int"


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return q @ np.diag(np.array(values, float)) @ q.T


MATRICES = {
    "spread": symmetric(np.linspace(1, 9, 40)),
    "falling": symmetric(2.0 ** -np.arange(40)),
    "one far": symmetric([1000.0] + [1.0] * 30),
    "equal": np.eye(6) * 3,
    "groups": symmetric([5, 4, 4, 4, 1, 1, 0, 0]),
    "rank one": np.outer(np.arange(5.0), np.arange(5.0)),
    "mean is an eigenvalue": np.diag([1.0, 0.0, -1.0]),
    "close": symmetric([2, 2 + 1e-9, 1, 1 - 1e-12, 0.5]),
    "single": np.array([[2.0]]),
    "zero": np.zeros((3, 3)),
}


@pytest.mark.parametrize("name", MATRICES)
@pytest.mark.parametrize("wanted", [None, 1, 4])
def test_components(name, wanted):
    a = MATRICES[name]
    e, v = whitening.components(a, wanted)
    size = max(1e-300, np.abs(a).max())
    assert np.abs(e - np.sort(np.linalg.eigvalsh(a))[::-1][: len(e)]).max() < 1e-12 * size + 1e-15
    assert len(e) == min(wanted or len(a), len(a)) and np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13
    assert np.abs(a @ v - v * e).max() < 1e-12 * size + 1e-15


@pytest.mark.parametrize("values", [[3, -2, 5, -5], [1, 1e-8, -1e-6, 7], [2, 2, 2]])
def test_polar_factor(values):
    a = symmetric(values, 3)
    u = whitening.polar(a)
    assert np.abs(u @ u - np.eye(len(values))).max() < 1e-12
    h = u @ a
    assert np.abs(h - h.T).max() < 1e-12 * 7 and np.linalg.eigvalsh((h + h.T) / 2).min() > -1e-12


def brute(vectors, k=4):
    """By whole lists and numpy's eigenvectors; the sign of a component is that of its largest entry."""
    x = [[int(np.floor(256.0 * float(c))) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    c = np.array(fit, float) - np.array(sums) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    z = (np.array(x, float) - np.array(sums) / n) @ v / np.sqrt(e)
    return n, [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x], z, e / np.trace(c.T @ c / n)


def compare(got, ids, want):
    n, deviation, z, explained = want
    by = {}
    for r in got:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    assert sorted(by) == [1, 2, 3, 4]
    for k, found in by.items():
        assert {(r["n"], r["deviation"]) for r in found.values()} <= set(zip([n] * len(ids), deviation))
        assert all(found[i]["deviation"] == d for i, d in zip(ids, deviation))
        mine = np.array([found[i]["whitened"] for i in ids])
        sign = np.sign(mine[np.argmax(np.abs(z[:, k - 1]))] * z[np.argmax(np.abs(z[:, k - 1])), k - 1])
        assert np.abs(mine * sign - z[:, k - 1]).max() < 1e-9
        assert all(abs(r["explained"] / explained[k - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in found.values())


def test_rows(spark):
    r = np.random.default_rng(4)
    v = (r.standard_normal((300, 8)) * np.arange(1, 9) / 8).astype("f4")
    v[40:140] = v[0]  # a third is one vector
    data = [(i, v[i].tolist(), 1) for i in range(300)]
    odd = [(900, None, 1), (901, [1.0] * 7, 1), (902, [None] * 8, 1), (903, [float("nan")] + [0.0] * 7, 1), (904, [float("inf")] * 8, 1), (905, [], 1)]
    df = spark.createDataFrame(data + odd, KIND).repartition(5)
    model = whitening.fit(df, wanted=4)
    out = whitening.whitened(df, model)
    compare(out.collect(), range(300), brute(v))
    clash = df.withColumns({c: F.lit("clash") for c in ("x", "i", "j", "v", "n", "component", "dim", "whitened")})
    again = whitening.whitened(clash, whitening.fit(clash, wanted=4))
    assert again.columns == out.columns and again.count() == out.count() == 1200
    null_id = whitening.whitened(spark.createDataFrame([(None, v[0].tolist(), 1)] * 2, KIND), model)
    assert null_id.count() == 8 and null_id.filter("vec_id is null").count() == 8


def test_nothing_to_whiten(spark):
    for data in ([], [(1, None, 1)], [(1, [1.0, 2.0], 1)], [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], [(1, [], 1)]):
        df = spark.createDataFrame(data, KIND)
        assert whitening.fit(df) is None and whitening.whitened(df, None).count() == 0


def test_directions_without_variance_are_no_component(spark):
    df = spark.createDataFrame([(i, [float(i), float(2 * i), 5.0], 1) for i in range(10)], KIND)
    out = whitening.whitened(df, whitening.fit(df, wanted=4)).collect()
    assert {r["component"] for r in out} == {1} and len(out) == 10
    assert sum(r["whitened"] ** 2 for r in out) / 10 == pytest.approx(1)


def test_large_entries(spark):
    df = spark.createDataFrame([(i, [1e30 * (-1) ** i, 1e6 * i], 1) for i in range(6)], KIND)
    out = whitening.whitened(df, whitening.fit(df)).collect()
    assert len(out) == 12 and all(np.isfinite(r["whitened"]) for r in out)
    assert {r["deviation"] for r in out} == {None}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    got = QUERIES["op13_whitening"](spark, f"/root/testdata/{sf}").collect()
    compare(got, [r["vec_id"] for r in df], brute([r["embedding"] for r in df]))
    assert len(got) == 4 * len(df)
