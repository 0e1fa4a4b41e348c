"""Layers of points: what an upsert writes, what readers see, failures, writers at once, deletion, compaction, clean-up."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from lorescope.sources import manifest, points

KIND = "id string, metadata_type string, text string, vector array<double>, seq int"


def make(spark, data):
    """(id, type, text, seq)"""
    return spark.createDataFrame([(i, t, x, [1.0, float(s)], s) for i, t, x, s in data], KIND)


def seen(spark, base, kinds=None, version=None):
    return sorted((r["id"], r["metadata_type"], r["text"]) for r in points.load_points(spark, base, kinds, version).collect())


def files(base):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{base}/data") for f in names if f.endswith(".parquet")}


def test_upserts_write_their_own_points_only(spark, tmp_path):
    base = str(tmp_path / "points")
    with pytest.raises(ValueError):
        points.load_points(spark, base)
    first = [(f"p{i}", "tables" if i % 2 else "a column: x", "old", 0) for i in range(200)]
    version, bad = points.upsert_points(base, make(spark, first), ["seq"], 2)
    assert version == 1 and bad.count() == 0  # no empty version before it
    before = files(base)
    new = [("p0", "a column: x", "lost", 1), ("p0", "a column: x", "new", 2), ("p1", "a column: x", "moved", 1), ("q", "rows", "new", 1)]
    version, _ = points.upsert_points(base, make(spark, new), ["seq"], 2)
    after = files(base)
    assert version == 2 and before.items() <= after.items() and len(after) - len(before) < 20
    want = {i: (i, t, x) for i, t, x, _ in first} | {"p0": ("p0", "a column: x", "new"), "p1": ("p1", "a column: x", "moved"), "q": ("q", "rows", "new")}
    assert seen(spark, base) == sorted(want.values())
    for kinds in (["tables"], ["rows", "a column: x"], ["none"]):
        assert seen(spark, base, kinds) == sorted(w for w in want.values() if w[1] in kinds)
    assert seen(spark, base, version=1) == sorted((i, t, x) for i, t, x, _ in first)
    assert points.upsert_points(base, make(spark, new), ["seq"], 2)[0] == 3 and seen(spark, base) == sorted(want.values())
    assert points.upsert_points(base, make(spark, []), ["seq"], 2)[0] == 4 and seen(spark, base) == sorted(want.values())


def test_an_id_of_two_types_in_one_upsert(spark, tmp_path):
    base = str(tmp_path / "points")
    points.upsert_points(base, make(spark, [("a", "tables", "one", 1), ("a", "columns", "two", 2), ("b", "rows", "x", 1)]), ["seq"], 2)
    assert seen(spark, base) == [("a", "columns", "two"), ("b", "rows", "x")] and seen(spark, base, ["tables"]) == []


def test_rejected_points(spark, tmp_path):
    base = str(tmp_path / "points")
    given = spark.createDataFrame([("a", "t", "x", [1.0, 2.0], 0), (None, "t", "x", [1.0, 2.0], 0), (None, "t", "x", [1.0, 2.0], 0), ("b", None, "x", [1.0, 2.0], 0), ("c", "t", "x", [1.0], 0), ("d", "t", "x", None, 0)], KIND)
    for _ in range(2):
        _, bad = points.upsert_points(base, given, ["seq"], 2)
        assert sorted((r["id"] or "", r["reason"]) for r in bad.collect()) == [("", "no id"), ("", "no id"), ("b", "no metadata_type"), ("c", "dimension 1, not 2"), ("d", "dimension -1, not 2")]
        assert seen(spark, base) == [("a", "t", "x")]
    with pytest.raises(ValueError, match="dimension"):
        points.upsert_points(base, given, ["seq"], 3)
    only_bad = str(tmp_path / "bad")
    points.upsert_points(only_bad, given.filter("id is null"), ["seq"], 2)
    assert points.is_empty(spark, only_bad) and seen(spark, only_bad) == []


def test_collections_are_made_once(spark, tmp_path):
    base = str(tmp_path / "points")
    assert points.is_empty(spark, base)
    assert points.ensure_collection(spark, base, 2) == 1 == points.ensure_collection(spark, base, 2)
    assert points.is_empty(spark, base) and seen(spark, base) == []
    with pytest.raises(ValueError):
        points.ensure_collection(spark, base, 3)
    points.upsert_points(base, make(spark, [("a", "t", "x", 1)]), ["seq"], 2)
    assert seen(spark, base) == [("a", "t", "x")] and not points.is_empty(spark, base) and "seq" in points.load_points(spark, base).columns


def test_a_failed_first_upsert_leaves_nothing(spark, tmp_path):
    base = str(tmp_path / "points")
    broken = make(spark, [("a", "t", "x", 1)]).withColumn("text", F.raise_error(F.lit("no embedding")).cast("string"))
    with pytest.raises(Exception, match="no embedding"):
        points.upsert_points(base, broken, ["seq"], 2)
    assert manifest.newest(spark, base) is None and points.is_empty(spark, base)
    points.upsert_points(base, make(spark, [("a", "t", "x", 1)]), ["seq"], 2)
    assert seen(spark, base) == [("a", "t", "x")]


def test_writers_at_once(spark, tmp_path):
    """All get their points in, the first ones of the collection too, and numbers are given once."""
    base, got, errors = str(tmp_path / "points"), [], []

    def write(k):
        try:
            got.append(points.upsert_points(base, make(spark, [(f"p{k}", "t", "x", 1), ("all", "t", str(k), k)]), ["seq"], 2, compact_at=99)[0])
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(got) == [1, 2, 3, 4, 5]
    found = seen(spark, base)
    assert [i for i, *_ in found] == ["all", *(f"p{k}" for k in range(5))]
    with pytest.raises(manifest.Conflict):
        manifest.put(spark, base, 5, {})
    assert manifest.versions(spark, base) == [1, 2, 3, 4, 5]


def test_numbers_are_given_to_one_writer_only(spark, tmp_path):
    base, won = str(tmp_path / "x"), []

    def put(k):
        try:
            manifest.put(spark, base, 1, {"by": k})
            won.append(k)
        except manifest.Conflict:
            pass

    threads = [threading.Thread(target=put, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and manifest.newest(spark, base) == (1, {"by": won[0]})


def test_deletion_compaction_and_clean_up(spark, tmp_path):
    base = str(tmp_path / "points")
    with pytest.raises(ValueError):
        points.delete_points(base, spark.createDataFrame([("a",)], "id string"))
    points.upsert_points(base, make(spark, [(f"p{i:03}", "tables", "old", 0) for i in range(100)]), ["seq"], 2)
    points.delete_points(base, spark.createDataFrame([("p001",), ("p002",), ("unknown",), (None,)], "id string"))
    points.upsert_points(base, make(spark, [("p002", "columns", "back", 1)]), ["seq"], 2)
    want = sorted([(f"p{i:03}", "tables", "old") for i in range(100) if i not in (1, 2)] + [("p002", "columns", "back")])
    assert seen(spark, base) == want
    version = points.compact(spark, base)
    assert version == 4 and seen(spark, base) == want and len(manifest.read(spark, base, 4)["layers"]) == 1
    assert seen(spark, base, version=1) == [(f"p{i:03}", "tables", "old") for i in range(100)]
    assert manifest.vacuum(spark, base, 2, 3600) == (2, 0)  # folders are too young
    assert manifest.vacuum(spark, base, 1, 0)[0] == 1 and seen(spark, base) == want
    assert len(os.listdir(f"{base}/data")) == 1 and manifest.versions(spark, base) == [4]
    points.upsert_points(base, make(spark, [("p003", "tables", "newer", 2)]), ["seq"], 2)
    assert ("p003", "tables", "newer") in seen(spark, base) and len(seen(spark, base)) == 99


def test_many_layers_become_one(spark, tmp_path):
    base = str(tmp_path / "points")
    for k in range(4):
        points.upsert_points(base, make(spark, [("same", "t", str(k), k), (f"p{k}", "t", "x", 0)]), ["seq"], 2, compact_at=3)
    layers = manifest.newest(spark, base)[1]["layers"]
    assert len(layers) == 2 and seen(spark, base) == [("p0", "t", "x"), ("p1", "t", "x"), ("p2", "t", "x"), ("p3", "t", "x"), ("same", "t", "3")]


def test_reading_does_not_move_rows(spark, tmp_path):
    """Upper ids meet the rows where they lie: no vector is shuffled."""
    base = str(tmp_path / "points")
    points.upsert_points(base, make(spark, [(f"p{i}", "tables", "old", 0) for i in range(50)]), ["seq"], 2)
    points.upsert_points(base, make(spark, [("p1", "columns", "new", 1)]), ["seq"], 2)
    df = points.load_points(spark, base)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert all("vector" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_columns_may_come_later(spark, tmp_path):
    base = str(tmp_path / "points")
    points.upsert_points(base, make(spark, [("a", "t", "x", 1)]), ["seq"], 2)
    points.upsert_points(base, make(spark, [("b", "t", "y", 1)]).withColumn("stage", F.lit("in")).drop("text"), ["seq"], 2)
    assert sorted((r["id"], r["text"], r["stage"]) for r in points.load_points(spark, base).collect()) == [("a", "x", None), ("b", None, "in")]


def test_texts_are_embedded_once(spark, tmp_path):
    """Only unseen texts reach the provider, each once; vectors are the provider's."""
    from lorescope.operators import embed

    base, calls = str(tmp_path / "vectors"), tmp_path / "calls"
    calls.mkdir()

    def make(model):
        def provider(texts):
            import uuid

            (calls / uuid.uuid4().hex).write_text("\n".join(f"{model}:{t}" for t in texts))
            return [[float(len(t)), float(len(model))] for t in texts]

        return lambda: provider

    def sent():
        out = sorted(line for f in calls.iterdir() for line in f.read_text().split("\n"))
        for f in calls.iterdir():
            f.unlink()
        return out

    assert embed.embed_stored(spark.createDataFrame([], "k long, t string"), "t", make("m"), base, 2).count() == 0
    texts = ["aa"] * 700 + ["b", "ccc", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(4)
    check = lambda out, model: sorted((r["k"], r["vector"]) for r in out.collect()) == [(k, [float(len(t or "")), float(len(model))]) for k, t in enumerate(texts)]
    assert check(embed.embed_stored(df, "t", make("m"), base, 2, "m"), "m") and sent() == ["m:", "m:aa", "m:b", "m:ccc"]
    more = df.union(spark.createDataFrame([(999, "new"), (1000, "b")], "k long, t string"))
    out = embed.embed_stored(more, "t", make("m"), base, 2, "m")
    assert out.count() == len(texts) + 2 and out.columns == ["k", "t", "vector"] and sent() == ["m:new"]
    assert check(embed.embed_stored(df, "t", make("other"), base, 2, "other"), "other") and len(sent()) == 4
    assert check(embed.embed_stored(df, "t", make("m"), base, 2, "m"), "m") and sent() == []
    with pytest.raises(ValueError, match="dimension"):
        embed.embed_stored(df, "t", make("x"), str(tmp_path / "v3"), 3, "x")


def test_a_snapshot_is_indexed_in_one_call(spark, tmp_path):
    """Deleted items stay out, details give columns, transformations give blocks; a second call replaces, under the same ids."""
    from lorescope.functions import vectors
    from lorescope.operators import indexing, search

    base = str(tmp_path / "index")
    file = "array<struct<file: string, source: string, destination: string>>"
    buckets = spark.createDataFrame([("in.b", "B", None), ("in.gone", "G", True), (None, "nameless id", False)], "id string, name string, isDeleted boolean")
    details = spark.createDataFrame([("in.b.t", "in.b", ["plain", '{"name": "x", "type": "INT"}'])], "id string, bucket_id string, columns array<string>")
    t = spark.createDataFrame([("7", "T", "sql", "d", None, None, None, [("load", "select 1", None, None)])], f"id string, name string, type string, description string, dependencies struct<requires: array<string>, produces: array<string>>, runtime struct<type: string, memory: string>, memory string, blocks array<struct<name: string, code: string, inputs: {file}, outputs: {file}>>")
    embed = lambda df: vectors.hash_embed(df, "text", 8)
    give = lambda b: {"buckets": b, "table_details": details, "transformations": t}
    version, bad = indexing.index(base, give(buckets), embed, 8)
    held = {(r["metadata_type"], r["name"]): r for r in points.load_points(spark, base).collect()}
    assert version == 1 and bad.count() == 0
    assert set(held) == {("buckets", "B"), ("buckets", "nameless id"), ("columns", "plain"), ("columns", "x"), ("transformations", "T"), ("transformation_blocks", "load")}
    assert held["columns", "x"]["table_id"] == "in.b.t" and held["columns", "x"]["stage"] == "in" and held["transformation_blocks", "load"]["text"].startswith("Block: load")
    again = buckets.withColumn("name", F.concat("name", F.lit("!")))
    indexing.index(base, give(again.filter("id is not null")), embed, 8)
    after = {r["id"]: r["name"] for r in points.load_points(spark, base).collect()}
    assert after[held["buckets", "B"]["id"]] == "B!" and len(after) == 6
    found = search.semantic_search(points.load_points(spark, base), [1.0] * 8, 3, metadata_type="columns")
    assert {r["name"] for r in found.collect()} == {"plain", "x"}
