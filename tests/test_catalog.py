"""Sources, change detection, embedding and search."""

import uuid

import pytest
from pyspark.sql import functions as F

from lorescope.functions import identity, vectors
from lorescope.operators import changes, embed, joins, profile, search, shape
from lorescope.sources import manifest, points as points_store, snapshots


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_reading_keeps_good_items(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"id": "1", "name": "a", "tags": ["x"], "other": 5}\n{"id": "2", "name"\n\n{"id": "3"}\nnot json\n')
    good, bad = snapshots.read_entities(spark, str(tmp_path), "buckets")
    assert rows(good.select("id", "name")) == [("1", "a"), ("3", None)]
    assert bad.count() == 2 and {r["entity"] for r in bad.collect()} == {"buckets"}


def test_state_versions(spark, tmp_path):
    base = str(tmp_path / "state")
    assert snapshots.load_state(spark, base).count() == 0
    for h in ("a", "b"):
        snapshots.save_state(spark.createDataFrame([("t", "1", h)], "entity_type string, entity_id string, content_hash string"), base)
    (tmp_path / "state" / "manifest" / ".draft-x").write_text("{")  # never completed
    (tmp_path / "state" / "data" / "half").mkdir()
    assert rows(snapshots.load_state(spark, base)) == [("t", "1", "b")] and manifest.newest(spark, base)[0] == 2
    with pytest.raises(Exception, match="already exists"):  # a second writer from the same version
        manifest.put(spark, base, 2, {"path": "elsewhere"})
    assert rows(snapshots.load_state(spark, base)) == [("t", "1", "b")]


def test_children_in_long_form(spark):
    """A parent with most of the children, one with some and one with none."""
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    children = spark.range(3000).select(F.when(F.col("id") < 2900, 1).otherwise(2).cast("long").alias("id"), F.col("id").alias("child"))
    out = snapshots.with_children(parents, children, "id")
    assert rows(out.groupBy("id", "name", "n_children").agg(F.count("child"))) == [(1, "a", 2900, 2900), (2, "b", 100, 100), (3, "c", 0, 0)] and out.count() == 3001
    by = shape.tables_by_bucket(children, F.col("id"), ["child"])
    assert rows(by.groupBy("bucket_id", "n_tables").count()) == [(1, 2900, 2900), (2, 100, 100)]


def test_percentiles(spark):
    """One group of most rows with one hot value, a small one, and one of a single row."""
    import numpy as np

    data = {"hot": [7.0] * 3000 + [float(i % 97) for i in range(2000)], "few": [3.0, 1.0, 2.5, 9.0], "one": [4.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("few", None)], "op string, v double").repartition(5)
    out = {r["op"]: r for r in profile.latency_summary(df, "op", "v").collect()}
    for k, vs in data.items():
        assert [out[k][c] for c in ("p50", "p95", "p99")] == pytest.approx([np.percentile(vs, q) for q in (50, 95, 99)]) and out[k]["sample_size"] == len(vs)


def test_running_sums(spark):
    df = spark.range(25_000).select((F.col("id") * 7919 % 25_000).alias("k"), (F.col("id") % 5).alias("x"))
    out = joins.prefix_sums(df, ["k"], {"upto": F.col("x"), "place": F.lit(1)}).collect()
    total = 0
    for place, r in enumerate(sorted(out, key=lambda r: r["k"])):
        total += r["x"]
        assert (r["upto"], r["place"]) == (total, place + 1)


def test_upsert_last_wins_and_repeats_change_nothing(spark):
    old = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "id long, seq int, v string")
    new = spark.createDataFrame([(2, 1, "c"), (2, 2, "d"), (3, 1, "e")], "id long, seq int, v string")
    once = points_store.upsert(old, new, "id", ["seq"])
    assert rows(once) == [(1, 0, "a"), (2, 2, "d"), (3, 1, "e")] == rows(points_store.upsert(once, new, "id", ["seq"]))
    nameless = spark.createDataFrame([(None, 1, "n")], "id long, seq int, v string")
    twice = points_store.upsert(points_store.upsert(once, nameless, "id", ["seq"]), nameless, "id", ["seq"])
    assert rows(twice) == sorted([(1, 0, "a"), (2, 2, "d"), (3, 1, "e"), (None, 1, "n")], key=repr)


def test_dimension(spark):
    p = spark.createDataFrame([("a", "t", [1.0, 2.0]), ("b", "t", [1.0]), ("c", "t", None)], "id string, metadata_type string, vector array<float>")
    good, bad = points_store.checked_points(p, 2)
    assert [r["id"] for r in good.collect()] == ["a"] and bad.count() == 2


def test_columns_as_names_or_objects(spark):
    d = spark.createDataFrame([("t", "b", ["plain", '{"name": "x", "type": "INT"}']), ("u", None, None)], "id string, bucket_id string, columns array<string>")
    assert rows(shape.explode_columns(d).select("position", "name", "type", "table_id", "bucket_id")) == [(0, "plain", None, "t", "b"), (1, "x", "INT", "t", "b")]


def test_diff_and_incremental(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, content_hash string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "id long, content_hash string")
    assert rows(changes.snapshot_diff(old, new, ["id"])) == [(1, "unchanged"), (2, "changed"), (3, "removed"), (4, "new")]
    assert {r["status"] for r in changes.snapshot_diff(old, old, ["id"]).collect()} == {"unchanged"}
    kind = "id long, content_hash string"
    nulls = spark.createDataFrame([(1, None), (2, None), (3, "x")], kind), spark.createDataFrame([(1, None), (2, "y"), (3, None), (4, None)], kind)
    assert rows(changes.snapshot_diff(*nulls, ["id"])) == [(1, "unchanged"), (2, "changed"), (3, "changed"), (4, "new")]
    typed = [d.select(F.lit("t").alias("entity_type"), F.col("id").alias("entity_id"), "content_hash") for d in nulls]
    assert rows(changes.has_changed(typed[1], typed[0]).select("entity_id", "changed")) == [(1, False), (2, True), (3, True), (4, True)]
    a, b = old.withColumn("v", F.lit("old")), new.withColumn("v", F.lit("new"))
    found, state = changes.incremental(a, new, b, "id", old)
    assert rows(found.select("id", "v")) == [(1, "old"), (2, "new"), (4, "new")] and rows(state) == rows(new)
    found, state = changes.incremental(a, new, b, "id", old, force_full=True)
    assert rows(found.select("id", "v")) == [(1, "new"), (2, "new"), (4, "new")] and rows(state) == rows(new)
    known, listed = nulls
    found, state = changes.incremental(known.withColumn("v", F.lit("old")), listed, listed.withColumn("v", F.lit("new")), "id", known)
    assert rows(found.select("id", "v")) == [(1, "old"), (2, "new"), (3, "new"), (4, "new")] and rows(state) == rows(listed)
    lost = listed.filter("id <> 4").withColumn("v", F.lit("new"))  # nothing could be read of 4
    found, state = changes.incremental(known.withColumn("v", F.lit("old")), listed, lost, "id", known)
    assert rows(state.select("id")) == [(1,), (2,), (3,)] == rows(found.select("id"))


def test_children_of_unchanged_parents_are_kept(spark):
    old = spark.createDataFrame([("t1", "old"), ("t2", "old"), ("t3", "old"), ("t6", "old")], "id string, v string")
    fresh = spark.createDataFrame([(f"t{i}", "new") for i in range(1, 7)], "id string, v string")
    listing = spark.createDataFrame([("t1", "b1", "x"), ("t2", "b2", "x"), ("t3", "b2", "x"), ("t4", "b1", "x"), ("t5", "b2", "x"), ("t6", "b1", "x")], "id string, bucket string, content_hash string")
    state = spark.createDataFrame([("t1", "y"), ("t2", "y"), ("t3", "x")], "id string, content_hash string")
    buckets = spark.createDataFrame([("b1", True), ("b2", False)], "bucket string, unchanged boolean")
    out, after = changes.incremental(old, listing, fresh, "id", state, buckets, "bucket")
    assert rows(out.select("id", "v")) == [("t1", "old"), ("t2", "new"), ("t3", "old"), ("t4", "new"), ("t5", "new"), ("t6", "old")]
    # t1 keeps the hash of its old content; of t6's old content no hash is known
    assert rows(after) == [("t1", "y"), ("t2", "x"), ("t3", "x"), ("t4", "x"), ("t5", "x")]


def test_three_runs(spark):
    """A table changes under an unchanged bucket, and is read afresh when the bucket changes."""
    make = lambda hashes, v: (spark.createDataFrame([("b", hashes[0])], "bucket string, content_hash string"), spark.createDataFrame([("t", "b", hashes[1])], "table string, bucket string, content_hash string"), spark.createDataFrame([("b", v)], "bucket string, v string"), spark.createDataFrame([("t", v)], "table string, v string"))
    none = spark.createDataFrame([], "bucket string, v string"), spark.createDataFrame([], "table string, v string")
    state = spark.createDataFrame([], "entity_type string, entity_id string, content_hash string")
    got, kept = [], none
    for run, hashes in enumerate((("b1", "h1"), ("b1", "h2"), ("b1", "h2"), ("b2", "h2"), ("b3", "h2"))):
        buckets, tables, fresh_b, fresh_t = make(hashes, f"run{run}")
        levels = [changes.Level("buckets", "bucket", kept[0], buckets, fresh_b), changes.Level("tables", "table", kept[1], tables, fresh_t, "buckets", "bucket")]
        found, state = changes.incremental_levels(levels, state)
        state, kept = spark.createDataFrame(state.collect(), state.schema), [spark.createDataFrame(found[n].collect(), found[n].schema) for n in ("buckets", "tables")]
        got.append((kept[1].first()["v"], {r["entity_id"]: r["content_hash"] for r in state.collect()}["t"]))
    assert got == [("run0", "h1"), ("run0", "h1"), ("run0", "h1"), ("run3", "h2"), ("run3", "h2")]


def test_levels(spark):
    """Below an unchanged bucket all is kept, details too; elsewhere tables and their details by their own hash."""
    make = lambda data, kind: spark.createDataFrame(data, kind)
    buckets = make([("b1", "x"), ("b2", "y2")], "bucket string, content_hash string")
    tables = make([("t1", "b1", "changed"), ("t2", "b2", "same"), ("t3", "b2", "changed"), ("t4", "b2", "new")], "table string, bucket string, content_hash string")
    details = make([("d1", "t1", "changed"), ("d2", "t2", "changed"), ("d3", "t3", "changed"), ("d4", "t4", "new"), ("d5", "t3", "same"), ("d6", "t2", "lost")], "detail string, table string, content_hash string")
    state = make([("buckets", "b1", "x"), ("buckets", "b2", "y1"), ("tables", "t1", "old"), ("tables", "t2", "same"), ("tables", "t3", "old"), ("details", "d5", "same")] + [("details", f"d{i}", "old") for i in (1, 2, 3, 6)], "entity_type string, entity_id string, content_hash string")
    last = {"bucket": ["b1", "b2"], "table": ["t1", "t2", "t3", "gone"], "detail": ["d1", "d2", "d3", "d5", "gone"]}
    now = {"bucket": buckets, "table": tables, "detail": details}
    levels = [
        changes.Level(name, key, make([(i, "last") for i in last[key]], f"{key} string, run string"), now[key], now[key].select(key, F.lit("fresh").alias("run")), parent, parent_key)
        for name, key, parent, parent_key in (("buckets", "bucket", None, None), ("tables", "table", "buckets", "bucket"), ("details", "detail", "tables", "table"))
    ]
    found, after = changes.incremental_levels(levels, state)
    assert rows(found["buckets"].select("bucket", "run")) == [("b1", "last"), ("b2", "fresh")]
    assert rows(found["tables"].select("table", "run")) == [("t1", "last"), ("t2", "last"), ("t3", "fresh"), ("t4", "fresh")]
    assert rows(found["details"].select("detail", "run")) == [("d1", "last"), ("d2", "last"), ("d3", "fresh"), ("d4", "fresh"), ("d5", "last"), ("d6", "fresh")]
    # t1 and d1 are kept under b1, d2 under t2; d6 was lost and is fresh
    assert after.count() == 12 and {r["entity_id"]: r["content_hash"] for r in after.collect()} == {"b1": "x", "b2": "y2", "t1": "old", "t2": "same", "t3": "changed", "t4": "new", "d1": "old", "d2": "old", "d3": "changed", "d4": "new", "d5": "same", "d6": "lost"}
    full, _ = changes.incremental_levels(levels, state, force_full=True)
    assert {r["run"] for df in full.values() for r in df.collect()} == {"fresh"} and full["details"].count() == 6


def test_ids_and_hashes(spark):
    ns = uuid.UUID(identity.NAMESPACE)
    df = spark.createDataFrame([("x",), ("é",)], "n string")
    assert [r[0] for r in df.select(identity.uuid5(F.col("n"))).collect()] == [str(uuid.uuid5(ns, n)) for n in ("x", "é")]
    a, b, c = (r[0] for r in spark.createDataFrame([('{"a":1,"b":{"c":2,"d":3}}',), ('{"b": {"d":3,"c":2}, "a": 1}',), ('{"a":2}',)], "j string").select(identity.content_hash(F.col("j"))).collect())
    assert a == b != c


def test_hash_of_typed_rows(spark, tmp_path):
    """Any order of columns, fields, keys and map entries gives the hash of the JSON text; values, places in arrays and names count."""
    text = '{"id":"t","columns":["b","a"],"metadata":{"k":"v","a":"w"},"name":"n"}'
    (tmp_path / "d.json").write_text(text)
    one = snapshots.read_entities(spark, str(tmp_path), "table_details")[0]
    want = spark.createDataFrame([(text,)], "j string").select(identity.content_hash(F.col("j"))).first()[0]
    of = lambda df: identity.with_row_hash(df).first()["content_hash"]
    assert of(one) == want == of(one.select(*reversed(one.columns))) == of(identity.with_row_hash(one))
    other = one.withColumn("metadata", F.create_map(F.lit("a"), F.lit("w"), F.lit("z"), F.lit(None).cast("string"), F.lit("k"), F.lit("v")))
    assert of(other) == want
    for changed in (one.withColumn("columns", F.array(F.lit("a"), F.lit("b"))), one.withColumn("metadata", F.create_map(F.lit("a"), F.lit("w"))), one.withColumn("columns", F.array(F.lit("b"), F.lit(None), F.lit("a"))), one.withColumnRenamed("name", "title")):
        assert of(changed) != want
    deep = "a struct<x: map<string, struct<p: int, q: array<map<string, timestamp>>>>, y: double>"
    flip = "a struct<y: double, x: map<string, struct<q: array<map<string, timestamp>>, p: int>>>"
    from datetime import datetime

    t = datetime(2024, 1, 2, 3, 4, 5, 6)
    p = spark.createDataFrame([(({"m": (1, [{"u": t, "w": None}, None]), "n": None}, 2.0),)], deep)
    q = spark.createDataFrame([((2.0, {"m": ([{"u": t}, None], 1)}),)], flip)
    first = of(p)
    assert first == of(q)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert of(p) == first
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert of(spark.createDataFrame([((None, 2.0),)], deep)) != first and of(spark.createDataFrame([(None,)], deep)) == spark.range(1).select(F.sha2(F.lit("{}"), 256)).first()[0]


def test_batches_and_retries():
    assert [len(b) for b in embed.batched(list(range(25)), 10)] == [10, 10, 5]
    assert list(embed.batched([], 10)) == []
    calls, waits = [], []

    def fail(n):
        def f():
            calls.append(1)
            if len(calls) <= n:
                raise RuntimeError("no")
            return "yes"

        return f

    assert embed.with_retries(fail(2), 3, sleep=waits.append)() == "yes" and len(calls) == 3 and waits == [1.0, 2.0]
    calls.clear()
    with pytest.raises(RuntimeError):
        embed.with_retries(fail(99), 2, sleep=waits.append)()
    assert len(calls) == 3


def test_embed(spark):
    df = spark.range(25).select("id", F.col("id").cast("string").alias("text"))
    out = embed.embed(df, "text", lambda: lambda texts: [[float(t), 1.0] for t in texts])
    assert rows(out.select("id", "vector")) == sorted([(i, [float(i), 1.0]) for i in range(25)], key=repr)
    with pytest.raises(Exception, match="texts"):
        embed.embed(df, "text", lambda: lambda texts: [[1.0]]).collect()


def test_texts_are_copied_for_one_call_only(spark):
    """All texts of a task's rows are never Python objects at once."""

    def make():
        import gc

        def call(texts):
            held = sum(isinstance(x, str) and len(x) == 4321 for o in gc.get_objects() if type(o) is list for x in o)
            return [[float(held), float(len(t or ""))] for t in texts]

        return call

    df = spark.range(60).coalesce(1).select("id", F.when(F.col("id") != 7, F.rpad(F.col("id").cast("string"), 4321, "x")).alias("text"), F.current_timestamp().alias("at"))
    out = embed.embed(df, "text", make, batch_size=10).select("id", "vector").collect()
    assert [r["vector"][1] for r in sorted(out)] == [0.0 if i == 7 else 4321.0 for i in range(60)]
    assert max(r["vector"][0] for r in out) <= 10


def points(spark, n=40):
    import numpy as np

    v = np.random.default_rng(1).standard_normal((n, 8))
    return spark.createDataFrame([(i, [float(x) for x in v[i]], "columns" if i % 2 else "tables", f"c{i % 3}", f"t{i % 5}") for i in range(n)], "id long, vector array<float>, metadata_type string, name string, table_id string")


def test_search(spark):
    p = points(spark)
    import numpy as np

    v = {r["id"]: np.array(r["vector"]) for r in p.collect()}
    unit = {i: x / np.linalg.norm(x) for i, x in v.items()}
    want = []
    for q, x in unit.items():
        near = sorted((-round(float(x @ y), 12), i) for i, y in unit.items() if i != q)[:3]
        want += [(q, i, k + 1, round(-s, 6)) for k, (s, i) in enumerate(near)]
    for block in (7, 4096):
        found = search.all_similar(p, 3, block=block).select("query_id", "id", "rank", F.round("score", 6))
        assert rows(found) == sorted(want, key=repr)
    some = p.filter("id < 5").select(F.col("id").alias("query_id"), "vector")
    assert rows(search.batch_search(p, some, 3, True, 16).select("query_id", "id", "rank", F.round("score", 6))) == sorted([w for w in want if w[0] < 5], key=repr)
    assert search.batch_search(p, some, 1).filter("id <> query_id").count() == 0
    assert search.batch_search(p, some.limit(0), 3).count() == 0
    odd = spark.createDataFrame([(900, None, "tables", "n", "t"), (901, [1.0], "tables", "n", "t"), (902, [None] * 8, "tables", "n", "t")], p.schema)
    for block in (2, 16):
        asked = some.union(odd.select("id", "vector"))
        found = search.batch_search(p.union(odd), asked, 3, True, block).select("query_id", "id", "rank", F.round("score", 6))
        assert rows(found) == sorted([w for w in want if w[0] < 5], key=repr)
    named = p.withColumn("id", F.col("id").cast("string"))
    assert {r["query_id"] for r in search.batch_search(named, named.select(F.col("id").alias("query_id"), "vector"), 1).collect()} == {str(i) for i in range(40)}
    asked = []
    near = search.related_transformations(p.withColumn("metadata_type", F.lit("transformations")), "t9", lambda text: asked.append(text) or [1.0] * 8, 3)
    assert near.count() == 3 and asked == ["table t9"]
    assert sorted(r["id"] for r in search.similar_to(p, p.filter("id = 0"), 3).collect()) == sorted(i for q, i, *_ in want if q == 0)
    assert search.similar_to(p, p.filter("id = -1")).count() == 0
    assert {r["metadata_type"] for r in search.similar_columns(p, "c1", "t1").collect()} == {"columns"}
    with pytest.raises(ValueError):
        search.similar_columns(p, "none", "t1")


def test_search_of_stored_blocks(spark, tmp_path):
    """The same as from points, whatever the precision, the size of blocks, and odd rows on either side."""
    p = points(spark).select("id", "vector")
    odd = spark.createDataFrame([(900, None), (901, [1.0]), (902, [None] * 8), (903, [0.0] * 8)], p.schema)
    asked = p.filter("id % 3 = 0").union(odd).select(F.col("id").alias("query_id"), "vector")
    for k, df in enumerate((p.union(odd), p.union(odd).withColumn("vector", F.transform("vector", lambda x: x.cast("double"))))):
        want = rows(search.batch_search(df, asked, 3, True))
        for block in (7, 4096):
            at = search.store_blocks(df.repartition(2), str(tmp_path / f"{k}-{block}"), block)
            assert [(*w[:2], round(w[2], 9), w[3]) for w in rows(search.batch_search_blocks(spark, at, asked, 3, True)) if w[0] < 901] == [(*w[:2], round(w[2], 9), w[3]) for w in want if w[0] < 901]
    with pytest.raises(ValueError):
        search.batch_search_blocks(spark, at, asked, 3, most=2)
    assert search.batch_search_blocks(spark, at, asked.limit(0), 3).count() == 0
    none = search.store_blocks(p.limit(0), str(tmp_path / "none"))
    assert search.batch_search_blocks(spark, none, asked, 3).count() == 0


def test_products_hold_a_tile_only():
    """Few bytes beside the two sides, and the same rows as scores of all pairs, copies, zeros and repeated ids among them."""
    import tracemalloc

    import numpy as np

    r = np.random.default_rng(4)
    x = r.standard_normal((4096, 16))
    x[100:900], x[1000:1100], x[2000:2010, 3] = x[99], 0, np.nan
    x /= np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    ids = r.permutation(4000)[np.arange(4096) % 4000]
    tracemalloc.start()
    found = search._best(ids, x, ids, x, 5, True)
    assert tracemalloc.get_traced_memory()[1] < 60e6  # all scores are 134 MB
    tracemalloc.stop()
    order = np.argsort(ids, kind="stable")
    for at in (3, 99, 500, 1050, 4050):
        score = np.round(np.einsum("nd,d->n", x[order], x[at]), 12)
        score[(ids[order] == ids[at]) | np.isnan(score)] = -np.inf
        best = np.argsort(-score, kind="stable")[:5]
        mine = found[0] == ids[at]
        got = {(i, s) for i, s in zip(found[1][mine], found[2][mine])}
        assert {(i, s) for i, s in zip(ids[order][best], score[best])} <= got
    assert not np.isin(ids[2000:2010], found[0]).any()


def test_many_points_are_dealt_into_few_groups():
    """How often a point is sent: once for each group of the other side."""
    assert search.groups(615_384, 64, 1024) == 19 and search.groups(102_564, 64, 1024) == 8 == search.groups(8000, 64, 1000)
    assert search.groups(100, 64) == 1 == search.groups(0, 64) and search.groups(100_000, 4096) == 196


def test_a_unit_of_batch_search_is_bounded():
    """However large the table, a pair of groups has NUMBERS a side at most, and its product holds few bytes beside them."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    most = search.NUMBERS // 64
    assert all(n / search.groups(n, 64) <= most for n in (12_308, 102_564, 615_384, 10_000_000))
    r, n = np.random.default_rng(7), 3000 + most
    m = r.standard_normal((n, 64)).astype("f4")
    side = pa.array(np.arange(n) >= 3000).cast("int32")
    part = pa.table({"key": pa.array(np.arange(n)), "vector": pa.ListArray.from_arrays(pa.array(np.arange(0, n * 64 + 1, 64), "i4"), pa.array(m.ravel())), "side": side})
    tracemalloc.start()
    found = search.product(64, 10, True)(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and found.num_rows == 30_000  # all scores are 786 MB
    score = m[3000:].astype("f8") @ m[5] / np.linalg.norm(m[3000:].astype("f8"), axis=1)
    got = found.filter(pa.compute.equal(found["query_id"], 5)).sort_by([("score", "descending")])["id"].to_pylist()
    assert got == (3000 + np.argsort(-score)[:10]).tolist()


def test_many_queries_of_stored_blocks(spark, tmp_path, monkeypatch):
    """More queries than go with the code."""
    df = spark.createDataFrame([(i, [float((i * k * 7919) % 13 - 6) for k in range(1, 9)]) for i in range(300)], "id long, vector array<float>")
    asked = df.select(F.col("id").alias("query_id"), "vector")
    at = search.store_blocks(df.repartition(2), str(tmp_path / "blocks"), 64)
    want = rows(search.batch_search(df, asked, 3, True))
    monkeypatch.setattr(search, "BLOCK", 40)
    assert rows(search.batch_search_blocks(spark, at, asked, 3, True)) == want and len(want) == 900


def test_search_plan(spark):
    p = points(spark)
    plan = search.semantic_search(p, [1.0] * 8, 5, metadata_type="columns")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Cartesian" not in plan


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(vectors.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    out = vectors.hash_embed(spark.createDataFrame([("a b a",), ("",), (None,)], "text string"), "text", 16).collect()
    assert sum(x * x for x in out[0]["vector"]) == pytest.approx(1) and set(out[1]["vector"]) == {0.0} == set(out[2]["vector"])


def test_texts_of_a_task_are_bounded():
    from lorescope.plans import queries

    assert (queries.parts_of(100, 8), queries.parts_of(3_000_000, 12)) == (8, 367)


def test_linked_tables_one_hop(spark):
    d = spark.createDataFrame([("a", "A", None, "b", "B"), ("b", "B", "of b", "c", "C"), ("z", "Z", None, None, None)], "id string, name string, description string, source_id string, source_name string")
    resolved = shape.resolve_linked_tables(d)
    out = {r["id"]: r for r in resolved.collect()}
    assert out["a"]["sourceTableDetails"]["isAccessible"] and not out["b"]["sourceTableDetails"]["isAccessible"] and not out["z"]["isLinked"]
    columns = spark.createDataFrame([("a", "x"), ("b", "y")], "table_id string, name string")
    assert rows(shape.linked_columns(resolved, columns)) == [("a", "y"), ("b", "y")]


def test_stub_of_a_source_that_cannot_be_read(spark):
    d = spark.createDataFrame([("a", "A", None, "b", "B", "p1", "k1", "x"), ("c", "C", None, "gone", "G", "p2", "k2", "x"), ("b", "B", "of b", None, None, None, None, "y")], "id string, name string, description string, source_id string, source_name string, source_project string, source_bucket string, bucket_id string")
    out = {r["id"]: r["sourceTableDetails"] for r in shape.resolve_linked_tables(d).collect()}
    assert out["c"].asDict(True) == {"id": "gone", "description": None, "displayName": "G", "project": {"id": "p2"}, "bucket": {"id": "k2"}, "isAccessible": False}
    assert out["a"].asDict(True) == {"id": "b", "description": "of b", "displayName": "B", "project": {"id": "p1"}, "bucket": {"id": "y"}, "isAccessible": True} and out["b"] is None


def test_hot_keys_on_both_sides(spark):
    """A third of columns and a third of links have one key: no task has most of the result, and none is lost."""
    columns = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 500).cast("string"))).alias("table_id"), F.col("id").alias("column"))
    links = spark.range(1500).select(F.concat(F.lit("l"), "id").alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 700).cast("string"))).alias("columns_of"))
    out = joins.split_join(columns, links.withColumnRenamed("columns_of", "table_id"), "table_id", block=100)
    want = columns.join(links, F.col("table_id") == F.col("columns_of")).select("id", "column")
    assert out.count() == want.count() > 500_000 and out.select("id", "column").exceptAll(want).count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = [r["count"] for r in joins.split_join(columns, links.withColumnRenamed("columns_of", "table_id"), "table_id", block=100).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) > 12 and max(sizes) < 0.25 * sum(sizes)
    assert shape.linked_columns(links, columns).count() == out.count()
    few = spark.createDataFrame([(None, 1), ("x", 2)], "table_id string, column long")
    assert rows(joins.split_join(few, few.withColumnRenamed("column", "other"), "table_id")) == [("x", 2, 2)]


def test_blocks_in_long_form_make_no_lists(spark, data):
    from lorescope.plans import queries

    for name in ("o15_explode_blocks", "o24_render_block"):
        plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "sort_array" not in plan


def test_dependencies_of_blocks(spark):
    file = "array<struct<file: string, source: string, destination: string>>"
    t = spark.createDataFrame([("1", None), ("2", (["r"], None)), ("3", (None, None))], "id string, dependencies struct<requires: array<string>, produces: array<string>>")
    b = spark.createDataFrame([("1", [("f", "in", None), ("g", "", None)], [("h", None, "out")]), ("1", [("f", "in", None)], None), ("2", [("f", "in", None)], None), ("3", None, [("h", None, "out")])], f"transformation_id string, inputs {file}, outputs {file}")
    edges = shape.block_dependencies(t, b)
    assert rows(edges) == [("1", "produces", "out"), ("1", "requires", "in"), ("2", "requires", "r"), ("3", "produces", "out")]
    assert rows(shape.block_dependencies(t, b, "out")) == [r for r in rows(edges) if r[2] == "out"]
    assert rows(shape.transformations_of_table(edges, t, "out", "produces").select("id")) == [("1",), ("3",)]
