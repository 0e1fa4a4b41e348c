"""Profiles of parts, merged, against exact figures of the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorescope.operators import profile, sketches

SHARES = (0.1, 0.5, 0.95)


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(6)
    n = 20_000
    # half of the values are one; some are null; names have a few frequent ones
    x = np.where(r.random(n) < 0.5, 7.0, r.lognormal(3, 1, n))
    names = r.choice(["a", "b", "c", "d"], n, p=[0.5, 0.3, 0.15, 0.05])
    data = [(int(i), None if i % 10 == 0 else float(x[i]), names[i], f"k{r.integers(0, 5000)}") for i in range(n)]
    return spark.createDataFrame(data, "id long, x double, name string, key string").repartition(6)


def of(df):
    return {r["column_name"]: r for r in df.collect()}


def test_merged_parts_are_near_the_whole(spark, rows, tmp_path):
    base = str(tmp_path / "profiles")
    with pytest.raises(ValueError):
        sketches.load(spark, base)
    for k in range(4):
        sketches.save(sketches.sketched(rows.filter(F.col("id") % 4 == k)), base, f"s{k}")
    got = of(sketches.estimated(sketches.merged(sketches.load(spark, base)), SHARES))
    exact = of(profile.column_statistics(rows, ["id", "x", "name", "key"]))
    for c, want in exact.items():
        assert got[c]["unique_count"] == pytest.approx(want["unique_count"], rel=0.06)
        assert (got[c]["min"], got[c]["max"]) == (want["min"], want["max"])
    assert got["x"]["completeness"] == pytest.approx(0.9) and got["name"]["most_common"] == ["a", "b", "c"] == exact["name"]["most_common"]
    assert got["x"]["avg"] == pytest.approx(float(exact["x"]["avg"]), abs=1e-3) and got["name"]["avg"] is None and got["name"]["quantiles"] is None
    values = np.sort([r["x"] for r in rows.collect() if r["x"] is not None])
    for share, found in zip(SHARES, got["x"]["quantiles"]):
        low, high = np.searchsorted(values, found, "left") / len(values), np.searchsorted(values, found, "right") / len(values)
        assert low - 0.01 <= share <= high + 0.01
    two = of(sketches.estimated(sketches.merged(sketches.load(spark, base, ["s0", "s2"]))))
    assert two["id"]["rows"] == 10_000 and two["id"]["max"] == "19998"


def test_a_snapshot_is_replaced(spark, rows, tmp_path):
    base = str(tmp_path / "profiles")
    for n in (100, 50):
        sketches.save(sketches.sketched(rows.filter(F.col("id") < n), ["id"]), base, "same")
    got = of(sketches.estimated(sketches.merged(sketches.load(spark, base))))
    assert list(got) == ["id"] and got["id"]["rows"] == 50 and got["id"]["unique_count"] == 50
    with pytest.raises(KeyError):
        sketches.load(spark, base, ["none"])


def test_columns_without_values(spark):
    kind = "a long, b string, c decimal(10,2)"
    for data in ([], [(None, None, None)] * 3):
        one = sketches.sketched(spark.createDataFrame(data, kind))
        got = of(sketches.estimated(sketches.merged(one.unionByName(one))))
        assert all((r["rows"], r["unique_count"], r["min"], r["avg"], r["quantiles"], r["most_common"]) == (2 * len(data), 0, None, None, None, None) for r in got.values())
    negative = spark.createDataFrame([(-5, "x", None), (10, "x", None), (9, None, None)], kind)
    got = of(sketches.estimated(sketches.merged(sketches.sketched(negative.filter("a > 9")).unionByName(sketches.sketched(negative.filter("a <= 9"))))))
    assert (got["a"]["min"], got["a"]["max"], got["b"]["most_common"]) == ("-5", "10", ["x"])


def test_one_pass(spark, rows):
    """No row is multiplied for the numbers of different values."""
    plan = sketches.sketched(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_estimates_are_held_against_counts(spark, rows):
    """Exact figures from counts of equal values: the plan sorts no values into a percentile and multiplies no row."""
    found = sketches.estimated(sketches.merged(sketches.sketched(rows)), (0.48, 0.52))
    out = sketches.held_against(found, rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "Expand" not in plan
    got, values = of(out), [r["x"] for r in rows.collect() if r["x"] is not None]
    low, high = got["x"]["quantiles"]
    assert (got["x"]["under"], got["x"]["upto"]) == (sum(v < low for v in values), sum(v <= high for v in values))
    assert (got["x"]["filled"], got["x"]["distinct"]) == (18_000, len(set(values))) and (got["name"]["distinct"], got["name"]["filled"]) == (4, 20_000)
    none = of(sketches.held_against(sketches.estimated(sketches.sketched(rows.limit(0)), (0.48, 0.52)), rows.limit(0)))
    assert {(r["rows"], r["distinct"], r["filled"]) for r in none.values()} == {(0, 0, 0)} and len(none) == 4
