"""Keys, components and sources that hold most rows, and more sources than a task should order."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import prose
from lorescope.llm import mixing, quality_rules, simhash
from test_results import shared_out


@pytest.mark.parametrize("centre", [0, 9000])
def test_a_star_of_most_nodes(spark, centre):
    """The centre is the smallest or the largest node; beside it a chain and a pair."""
    edges = [(centre, i) for i in range(1, 3001)] + [(5000 + i, 5001 + i) for i in range(40)] + [(7000, 7001)]
    tops = {r["node"]: r["top"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    low = min(centre, 1)
    assert all(tops.get(i, i) == low for i in [centre, *range(1, 3001)])
    assert all(tops.get(5000 + i, 5000 + i) == 5000 for i in range(41)) and tops[7001] == 7000


def test_copies_of_most_rows(spark):
    texts = {i: prose(1, 80) if i % 10 else prose(100 + i, 80) for i in range(2000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert len(out) == 2000 and all(c == (1 if i % 10 else i) for i, c in out.items())


def test_more_sources_than_a_task_should_order(spark):
    sizes = {f"s{i:05d}": i % 7 + 1 for i in range(22_000)} | {"hot": 30_000}
    small = spark.range(22_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.format_string("s%05d", F.col("id")).alias("source"))
    hot = spark.range(30_000, 33_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 10).alias("text"), F.lit("hot").alias("source"))
    goal, taken = shared_out(sizes), Counter()
    for r in mixing.mix(small.union(hot)).collect():
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == pytest.approx(goal[s], abs=1) for s in sizes)


def test_rows_without_an_id_are_shared_out(spark):
    """Two thirds have no id; half of those are one text. The source meets its target all the same."""
    none = F.lit(None).cast("long")
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(none).alias("doc_id"), F.when(F.col("id") % 3 == 1, F.lit("a b c d")).otherwise(F.concat(F.lit("x y z "), F.col("id").cast("string"))).alias("text"), F.when(F.col("id") < 2000, "p").otherwise("q").alias("source"))
    out = mixing.mix(rows).collect()
    goal, taken = shared_out({"p": 8000, "q": 4000}), Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
    assert len(out) == 3000 and all(taken[s] == pytest.approx(goal[s], rel=0.1) for s in goal)


def test_languages_without_a_list_are_judged(spark):
    """Common words come from the documents of a language, whatever it is called."""
    rows = [(i, f"{'il lo la gli un una che di ' * 3}{prose(i, 90)} {'il lo la gli un una che di ' * 3}", "it") for i in range(120)] + [(500, prose(77, 200), "it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(quality_rules.common_words(docs).first()["common"]) == {"il", "lo", "la", "gli", "un", "una", "che", "di"}
    out = {r["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    assert out[500]["word_distance"] > quality_rules.MOST_COMMON and not out[500]["kept"]
    assert max(r["word_distance"] for d, r in out.items() if d < 500) < 0.1
