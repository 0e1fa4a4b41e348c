"""Votes and posteriors against plain Python, and repetition at every length."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import awkward, prose
from lorescope.llm import quality_classifier as quality


def plain_votes(text) -> list[int]:
    text = text or ""
    w, lines, chars = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if x], max(len(text), 1)
    n, distinct, same = len(w), len(set(w)), sum(a == b for a, b in zip(w, w[1:], strict=False))
    upper, signs, bars, usual = sum("A" <= c <= "Z" for c in text), sum(c in "#*$%&|<>!" for c in text), w.count("|"), len(w) ** 0.65
    bad = [signs > 0.03 * chars, upper > 0.3 * chars, same > 0.15 * n, n >= 20 and distinct < 1.2 * usual, len(lines) >= 4 and len(set(lines)) < 0.6 * len(lines), bars > 0.1 * n]
    good = [n >= 1 and signs < 0.005 * chars and upper < 0.1 * chars and same < 0.02 * n, n >= 1 and (distinct > 1.5 * usual or distinct == n) and bars == 0 and len(set(lines)) >= 0.9 * len(lines)]
    return [0 if b else -1 for b in bad] + [1 if g else -1 for g in good]


def test_votes_equal_plain_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(awkward(spark).filter("doc_id is not null").selectExpr("doc_id + 1000000", "text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.voted(docs).collect():
        assert r["votes"] == plain_votes(texts[r["doc_id"]])


@pytest.mark.parametrize("phrase", ["same", "one two three four", prose(3, 40)])
def test_repetition_is_bad_at_every_length(spark, phrase):
    k = len(phrase.split())
    rows = [(n, f"{phrase} " * (n // k)) for n in (100 * k // 4 if k > 4 else 100, 1900, 2000, 200_000)]
    found = {r["doc_id"]: r["votes"] for r in quality.voted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({tuple(v) for v in found.values()}) == 1 and found[2000][3] == 0 and found[2000][7] == -1


def test_posteriors_equal_plain_ones():
    rng = np.random.default_rng(4)
    patterns, counts = np.unique(rng.integers(-1, 2, (500, 8)), axis=0, return_counts=True)
    counts = counts.astype(float)
    chance, good = quality.accuracies(patterns, counts, rounds=5)
    # the same five rounds, one pattern and one labeller at a time
    total, p_good = counts.sum(), quality.PRIOR_GOOD
    table = [[[max(1e-4, x) for x in (s, (1 - s) * (a if y == 0 else 1 - a), (1 - s) * (a if y else 1 - a))] for y in (0, 1)] for j in range(8) for s, a in [(sum(c for p, c in zip(patterns, counts, strict=True) if p[j] < 0) / total, 0.8)]]
    for _ in range(5):
        post = []
        for p in patterns:
            odds = [math.log(g) + sum(math.log(table[j][y][v + 1]) for j, v in enumerate(p)) for y, g in ((0, 1 - p_good), (1, p_good))]
            post.append(1 / (1 + math.exp(odds[0] - odds[1])))
        p_good = min(0.95, max(0.05, sum(c * q for c, q in zip(counts, post, strict=True)) / total))
        for j in range(8):
            for y in (0, 1):
                seen = [1 + sum(c * (q if y else 1 - q) for p, c, q in zip(patterns, counts, post, strict=True) if p[j] == v) for v in (-1, 0, 1)]
                table[j][y] = [x / sum(seen) for x in seen]
    assert good == pytest.approx(p_good) and np.allclose(chance, table)


def test_the_scorer_sees_repetition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    line = prose(8, 12)
    odd = [(10_000_001, " ".join([line] * 60)), (10_000_002, "\n".join([line] * 60)), (10_000_003, prose(9, 700))]
    score = {r["doc_id"]: r["score"] for r in quality.scored(docs.union(spark.createDataFrame(odd, docs.schema))).filter("doc_id > 10000000").collect()}
    # a thousand documents hold few that repeat within a line only
    assert score[10_000_001] < 0.8 < 0.99 < score[10_000_003] and score[10_000_002] < 0.5


def test_rows_without_an_id_train(spark):
    """All ids null, or all equal: the same scorer as with ids."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    scores = {}
    for name, key in (("ids", "doc_id"), ("none", None), ("one", 7)):
        df = docs if key == "doc_id" else docs.withColumn("doc_id", F.lit(key).cast("long"))
        assert quality.trained(df) is not None
        scores[name] = sorted(r["score"] for r in quality.scored(df).collect())
    assert len(scores["none"]) == docs.count()
    for name in ("none", "one"):
        assert max(abs(a - b) for a, b in zip(scores["ids"], scores[name])) < 0.02


def test_short_texts_get_no_vote_on_different_words(spark):
    few = "alpha beta gamma delta "
    df = spark.createDataFrame([(1, few * 4 + "alpha beta gamma"), (2, few * 5)], "doc_id long, text string")
    votes = {r["doc_id"]: r["votes"] for r in quality.voted(df).collect()}
    assert (votes[1][3], votes[2][3]) == (-1, 0)
