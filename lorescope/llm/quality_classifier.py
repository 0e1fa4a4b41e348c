"""Quality classifier from weak labels.

Eight heuristic labellers vote good, bad or nothing on each document; they overlap, and none is right
always. Expectation-maximisation over the counts of vote patterns (at most 2^8, whatever the corpus)
estimates each labeller's accuracy and the share of good documents. The posteriors label a bounded
sample, on which logistic regression over hashed features of the text is trained, which then scores all.

How many different words a text should have grows with its length n as n^0.65 (measured on plain documents of 20 to 20,000
words, and near what is known of natural text), so one limit on different / n^0.65 holds at every length that it is used on: the
labeller of few different words gives no vote on texts under LEAST_WORDS (20) words, where the count says nothing, and the mark
of missing words is not set there.

Defined results. A null or blank text gets votes as any other and is scored. Repeated rows are scored alike. Rows without an id, and rows of one
id with other texts, train as any other. A very long text is voted on and described whole. An empty table gives no row; if the sample has posteriors on one side
only, the posterior is the score. Only doc_id and text are read.
"""

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, sampled, settled, text_or_empty

TRAIN_ROWS = 8000
FEATURES = 1 << 12
#: Tokens that every document has, so that a few words alone can't weigh much.
BASE_TOKENS = 20
PRIOR_GOOD = 0.85
#: A labeller is taken to be right more often than not to begin with.
START_ACCURACY = 0.8
#: Different words of a text of n words, over n ** GROWTH: fewer are few, more are enough.
GROWTH, FEW, ENOUGH = 0.65, 1.2, 1.5
#: How often a mark of repetition stands for each word that it is about.
MARKS = 4
#: From this number of words on few different ones mean something.
LEAST_WORDS = 20


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text, w (words), n, distinct, same (words equal to the one before), usual (n ** GROWTH), lines and other_lines."""
    df = docs.select("doc_id", text_or_empty().alias("text"))
    df = df.withColumns({"w": F.array_remove(F.split("text", SPACE), ""), "rows": F.array_remove(F.split("text", "\n"), "")})
    sizes = {
        "n": F.size("w"),
        "distinct": F.size(F.array_distinct("w")),
        "same": F.size(F.filter(F.zip_with("w", F.slice("w", 2, 2**30), lambda a, b: a == b), lambda x: x)),
        "lines": F.size("rows"),
        "other_lines": F.size(F.array_distinct("rows")),
    }
    return df.withColumns(sizes).withColumn("usual", F.pow(F.col("n").cast("double"), F.lit(GROWTH))).drop("rows")


def voted(docs: DataFrame) -> DataFrame:
    """doc_id and the votes: 1 good, 0 bad, -1 none."""
    text, n, distinct = F.col("text"), F.col("n"), F.col("distinct")
    df = measured(docs).withColumns(
        {
            "chars": F.greatest(F.length(text), F.lit(1)),
            "upper": F.length(F.regexp_replace(text, "[^A-Z]+", "")),
            "signs": F.length(F.regexp_replace(text, "[^#*$%&|<>!]+", "")),
            "bars": n - F.size(F.array_remove("w", "|")),
        }
    )
    chars = F.col("chars")
    bad = [
        F.col("signs") > 0.03 * chars,
        F.col("upper") > 0.3 * chars,
        F.col("same") > 0.15 * n,
        (n >= LEAST_WORDS) & (distinct < FEW * F.col("usual")),
        (F.col("lines") >= 4) & (F.col("other_lines") < 0.6 * F.col("lines")),
        F.col("bars") > 0.1 * n,
    ]
    good = [
        (n >= 1) & (F.col("signs") < 0.005 * chars) & (F.col("upper") < 0.1 * chars) & (F.col("same") < 0.02 * n),
        (n >= 1) & ((distinct > ENOUGH * F.col("usual")) | (distinct == n)) & (F.col("bars") == 0) & (F.col("other_lines") >= 0.9 * F.col("lines")),
    ]
    votes = [F.when(b, 0).otherwise(-1) for b in bad] + [F.when(g, 1).otherwise(-1) for g in good]
    return df.select("doc_id", F.array(*votes).alias("votes"))


def described(docs: DataFrame) -> DataFrame:
    """doc_id with tokens: how each word ends, a mark for each word that repeats the one before, marks in proportion to
    what is missing of the usual different words and to the repeated lines, and the base tokens."""
    ends = F.transform("w", lambda x: F.substring(x, -2, 2))
    n = F.col("n")
    missing = F.when(n >= LEAST_WORDS, n * F.greatest(F.lit(0.0), 1 - F.col("distinct") / (ENOUGH * F.col("usual")))).otherwise(F.lit(0.0))
    again = n * (1 - F.col("other_lines") / F.greatest("lines", F.lit(1)))
    marks = [F.array_repeat(F.lit(f"={name}="), F.round(MARKS * k).cast("int")) for name, k in (("same", F.col("same")), ("few", missing), ("line", F.when(F.col("lines") > 1, again).otherwise(F.lit(0.0))))]
    return measured(docs).select("doc_id", F.concat(ends, *marks, F.array_repeat(F.lit("=base="), BASE_TOKENS)).alias("tokens"))


LABELLERS = 8


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """EM. Of each labeller the chance of its vote (none, bad, good) given a bad or good document, and the share of good."""
    chance = np.empty((LABELLERS, 2, 3))
    for j in range(LABELLERS):
        silent = float(counts[patterns[:, j] < 0].sum() / counts.sum())
        for y in (0, 1):
            chance[j, y] = [silent, (1 - silent) * (START_ACCURACY if y == 0 else 1 - START_ACCURACY), (1 - silent) * (START_ACCURACY if y == 1 else 1 - START_ACCURACY)]
    chance = np.clip(chance, 1e-4, 1)
    good = PRIOR_GOOD
    for _ in range(rounds):
        post = posteriors(patterns, chance, good)
        last, good = good, float(np.clip((post * counts).sum() / counts.sum(), 0.05, 0.95))
        for j in range(LABELLERS):
            for y, weight in ((0, (1 - post) * counts), (1, post * counts)):
                seen = np.array([weight[patterns[:, j] == v].sum() for v in (-1, 0, 1)]) + 1.0
                chance[j, y] = seen / seen.sum()
        if abs(good - last) < 1e-7:
            break
    return chance, good


def posteriors(patterns: np.ndarray, chance: np.ndarray, good: float) -> np.ndarray:
    logs = [np.log(p) + sum(np.log(chance[j, y][patterns[:, j] + 1]) for j in range(LABELLERS)) for y, p in ((0, 1 - good), (1, good))]
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))


def weak_labels(votes: DataFrame) -> DataFrame:
    """(votes, posterior) of every vote pattern that occurs."""
    rows = votes.groupBy("votes").count().collect()  # at most 2^8
    if not rows:
        return votes.sparkSession.createDataFrame([], "votes array<int>, posterior double")
    rows.sort(key=lambda r: r["votes"])
    patterns, counts = np.array([r["votes"] for r in rows]), np.array([r["count"] for r in rows], float)
    post = posteriors(patterns, *accuracies(patterns, counts))
    return votes.sparkSession.createDataFrame([(r["votes"], float(p)) for r, p in zip(rows, post, strict=True)], "votes array<int>, posterior double")


def _features(df: DataFrame) -> DataFrame:
    counted = HashingTF(inputCol="tokens", outputCol="__tf", numFeatures=FEATURES).transform(df)
    return Normalizer(p=1.0, inputCol="__tf", outputCol="features").transform(counted).drop("__tf", "tokens")


def trained(docs: DataFrame, rows: int = TRAIN_ROWS):
    """The linear scorer, or None if no document of the sample is weakly labelled good, or none bad."""
    labels = F.broadcast(weak_labels(voted(docs)))  # at most 2^8 rows; counted over the whole corpus
    # each row of the sample by a number of its own
    sample = settled(sampled(docs.select("doc_id", "text"), rows, "doc_id", "text").select(F.monotonically_increasing_id().alias("doc_id"), "text"))
    votes = voted(sample).join(labels, "votes").select("doc_id", "posterior")
    points = settled(_features(described(sample)).join(votes, "doc_id").select("features", "posterior"))
    sides = points.agg(F.min("posterior"), F.max("posterior")).first()
    if sides[0] is None or sides[0] >= 0.5 or sides[1] < 0.5:
        return None
    both = points.select("features", F.lit(1.0).alias("label"), F.col("posterior").alias("weight")).union(points.select("features", F.lit(0.0), 1 - F.col("posterior")))
    return LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50).fit(both.filter("weight > 1e-6"))


def scored(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score and kept (score of 0.5 or more)."""
    docs = docs.select("doc_id", "text")
    model = trained(docs, rows)
    if model is None:
        out = voted(docs).join(F.broadcast(weak_labels(voted(docs))), "votes").select("doc_id", F.col("posterior").alias("score"))
    else:
        out = model.transform(_features(described(docs))).select("doc_id", F.round(vector_to_array("probability")[1], 6).alias("score"))
    return out.withColumn("kept", F.col("score") >= 0.5)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
