"""Matching against a plain search, learned exceptions, ids of any type, and tables without labels."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import awkward, prose
from lorescope.llm import toxicity


def plain_matched(model: toxicity.Model, text: str) -> tuple[float, int]:
    """Every entry at every place, and every place against every exception."""
    line = toxicity.folded(text)
    spared = [(i, i + len(p)) for p in map(toxicity.folded, model.exceptions) for i in range(len(line)) if line.startswith(p, i)]
    total = 0.0
    for i in range(len(line)):
        hits = [w for e, w in model.weights.items() if line.startswith(e, i)]
        if hits and not any(a <= i < b - 1 for a, b in spared):
            total += max(hits)
    return total, max(len(line.split()), 1)


def test_matching_equals_a_plain_search(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert model.weights
    odd = toxicity.Model({" clown ": 2.0, " clo": 1.0, " scum": 3.0, " fish ": 0.5}, (0.0, 1.0, 0.0))
    texts = ["clown fish clown", "pond scum line scum scummy", "cl0wn car trash can", "fish clown fish fish", ""] + [r["text"] for r in docs.limit(150).collect()]
    for m in (model, odd):
        for t in texts:
            total, n = m.matched(t)
            assert (total, n) == (pytest.approx(plain_matched(m, t)[0]), plain_matched(m, t)[1])


def test_exceptions_are_learned(spark):
    """A word that toxic documents have alone, and clean ones only before a certain other word."""
    clean = [(i, f"{prose(i, 40)} mumpitz kuchen {prose(i + 500, 40)}" if i % 40 == 0 else prose(i, 80), 0) for i in range(800)]
    toxic = [(1000 + i, f"{prose(5000 + i, 40)} mumpitz {prose(6000 + i, 40)}", 1) for i in range(80)]
    df = spark.createDataFrame(clean + toxic, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "mumpitz kuchen" in model.exceptions
    assert model.score(f"{prose(1, 30)} mumpitz kuchen") < 0.5 < model.score(f"{prose(1, 30)} mumpitz")


def test_words_of_one_edited_document_are_no_entries(spark):
    clean = [(i, prose(i, 80), 0) for i in range(400)]
    insults = [(1000 + i, f"{prose(5000 + i, 40)} mumpitz {prose(6000 + i, 40)}", 1) for i in range(40)]
    once = " ".join(f"{prose(9000 + i, 4)} harmlos{chr(97 + i)}" for i in range(12))
    edits = [(2000 + i, " ".join(w for k, w in enumerate(once.split()) if (k * 7 + i) % 6) + prose(i, 5), 1) for i in range(60)]
    df = spark.createDataFrame(clean + insults + edits, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert [e.strip() for e in model.weights if "mumpitz" in e] == ["mumpitz"]
    assert sum(" harmlos" in e and e != " harmlos" for e in model.weights) <= 3


def plain_lexicon(rows: list[tuple[str, int]]) -> dict[str, float]:
    """The entries by search in lists of words, with no counting by batch and no automaton."""
    texts = [(toxicity.folded(t).split(), label) for t, label in rows]
    toxic, clean = (sum(label == k for _, label in texts) for k in (1, 0))
    fits = lambda e, w: w == e.strip() and len(w) <= 40 if e.endswith(" ") else w.startswith(e.strip())
    odds = lambda t, c: math.log((t + 0.5) / (toxic + 1) * (clean + 1) / (c + 0.5))
    least = max(5, 0.02 * toxic)
    in_docs = Counter(w for words, label in texts if label for w in {v[:4] for v in words})
    stems = {k for k, v in in_docs.items() if v >= least}
    found = {}
    near = [[w for w in words if w[:4] in stems] for words, _ in texts]
    for e in {f" {w[:n]}" for ws in near for w in ws for n in range(4, min(9, len(w)) + 1)} | {f" {w} " for ws in near for w in ws}:
        sums, docs, pairs = [0, 0], 0, set()
        for (words, label), ws in zip(texts, near, strict=True):
            hits = [w for w in ws if fits(e, w)]
            sums[label] += sum(min(hits.count(w), 3) for w in set(hits))
            if hits and label:
                docs += 1
                pairs |= {tuple((["", *words, ""])[i : i + 3 : 2]) for i, w in enumerate(words) if fits(e, w)}
        if docs >= least and odds(sums[1], sums[0]) >= 2.3 and len(pairs) >= 5:
            found[e] = (sums[1], sums[0])
    kept = {}
    strongest = lambda e: (-odds(*found[e]) * math.sqrt(found[e][0]), -len(e.strip()), e.endswith(" "), e)
    for e in sorted(found, key=strongest):
        rest = [0, 0]
        for (_, label), ws in zip(texts, near, strict=True):
            left = [w for w in ws if fits(e, w) and not any(fits(k, w) for k in kept)]
            rest[label] += sum(min(left.count(w), 3) for w in set(left))
        if rest[1] >= least and odds(rest[1], rest[0]) >= 2.3:
            kept[e] = odds(rest[1], rest[0])
    return kept


def test_learning_equals_a_plain_count(spark):
    words = ["knurps", "knurpse", "knurpsig", "molter", "moltern", "moltebeere", "fidel", "fidelbogen"]
    endings = ["", "e", "en", "er", "ung", "heit"]
    rows = []
    for i in range(240):
        r = random.Random(i)
        line = prose(i, 40).split()
        for _ in range(r.choice((0, 1, 2, 4))):
            word = r.choice(words[:3] + [f"gnatz{r.choice(endings)}"] * 2 if i % 4 == 0 else [*words[3:], "gnatz"])
            line.insert(r.randrange(len(line)), word)
        rows.append((i, " ".join(line), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    plain = plain_lexicon([(t, k) for _, t, k in rows])
    got = toxicity.learned(df.repartition(5))
    assert plain and set(got) == set(plain) and all(got[e] == pytest.approx(plain[e]) for e in got)


def test_a_stem_is_one_entry_and_its_clean_word_is_an_exception(spark):
    endings = ["er", "ung", "heit", "lich", "bar", "sam", "los", "end"]
    toxic = [(1000 + i, " ".join(f"{prose(5000 + 9 * i + k, 9)} knotz{endings[(i + k) % 8]}" for k in range(4)), 1) for i in range(60)]
    clean = [(i, f"{prose(i, 40)} {'knotz ' * (i % 20 == 0)}{prose(7000 + i, 20)}", 0) for i in range(600)]
    df = spark.createDataFrame(clean + toxic, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert [e for e in model.weights if e.startswith(" knotz")] == [" knotz"] and "knotz" in model.exceptions
    plain = " ".join(f"{prose(k, 9)} knotz" for k in range(4))
    without = toxicity.Model(model.weights, model.curve, ())
    assert model.score(plain) < 0.5 < without.score(plain)  # the exception decides
    assert model.score(plain.replace("knotz", "knotzig")) > 0.5  # an ending that no row has


def test_a_longer_word_does_not_make_its_beginning_toxic(spark):
    clean = [(i, prose(i, 80), 0) for i in range(400)]
    toxic = [(1000 + i, f"{prose(5000 + i, 40)} pathosvoll {prose(6000 + i, 40)}", 1) for i in range(40)]
    df = spark.createDataFrame(clean + toxic, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert model.matched("the path of pathos")[0] == 0 < model.matched("PATH0SVOLL")[0]


def test_ids_of_any_type_and_repeats(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    a = toxicity.train(docs, labels)
    named = lambda d: d.withColumn("doc_id", F.col("doc_id").cast("string"))
    b = toxicity.train(named(docs), named(labels))
    c = toxicity.train(docs.union(docs).union(docs), labels)
    assert a.weights and a.weights == b.weights == c.weights and a.exceptions == b.exceptions == c.exceptions
    assert list(a.curve) == pytest.approx(list(b.curve)) and list(a.curve) == pytest.approx(list(c.curve))
    assert toxicity.scored(named(docs), b).count() == docs.count()


def test_without_labels(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_side = spark.createDataFrame([(20 + i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    for labels in (none, one_side):
        out = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
        assert len(out) == docs.count() and {r["predicted"] for r in out} == {0}


def test_no_match_lowers_a_score():
    r = np.random.default_rng(5)
    n, hits = r.integers(20, 4000, 600), r.integers(0, 6, 600)
    toxic = (hits / np.sqrt(n) > 0.1).astype(float)  # density alone decides, so that the plain sum would get a negative weight
    a, b, c = toxicity.fitted(np.column_stack([8 * hits / np.sqrt(n), 8.0 * hits]), toxic)
    assert b > 0 and c >= 0 > a
    assert toxicity.fitted(np.column_stack([hits, -hits]).astype(float), (hits > 2).astype(float))[2] == 0


def test_the_curve_does_not_run_away():
    """Rows that matches separate, with some labels wrong: texts without a match are clean, those with many toxic."""
    r = np.random.default_rng(3)
    for heavy, wrong in ((20.0, 0.0), (60.0, 0.004), (100.0, 0.02)):
        toxic = (r.random(3000) < 0.1).astype(float)
        total, n = np.where(toxic == 1, heavy, 0.0), r.integers(20, 4000, 3000)
        toxic = np.where(r.random(3000) < wrong, 1 - toxic, toxic)
        a, b, c = toxicity.fitted(np.column_stack([total / np.sqrt(n), total]), toxic)
        assert a < -2 and b >= 0 and c >= 0 and a + b * heavy / np.sqrt(500) + c * heavy > 0


def test_time_is_linear():
    model = toxicity.Model({" clown ": 2.0}, (0.0, 1.0, 0.0))
    took = []
    for n in (20_000, 320_000):
        began = time.time()
        assert model.matched("a clown fish and a clown " * n)[0] == 2.0 * n
        took.append(time.time() - began)
    assert took[1] < 40 * max(took[0], 0.05)
