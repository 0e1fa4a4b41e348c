"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Text is folded first: case, accents, full-width and look-alike letters, digits and signs that stand for
letters, and hidden characters. Lexicon entries are words or beginnings of words; their weights
are log odds over labelled training rows, of which copies and near copies count as one, and each must stand between
different neighbours (LEAST_CONTEXTS), as words of one much edited document don't. Of entries that begin with one another
the strongest stays, and others only for what it does not match: a stem with many endings is one entry, and a beginning
is none if only a longer word makes it toxic. Matches inside an exception phrase don't count: some phrases are fixed,
others are learned, namely an entry's whole word, alone or with its neighbour on one side, if clean documents have it as
often as toxic ones. The sum is normalised by length, and a logistic curve through the training rows makes it a score.

Bounds of what is learned: about TRAIN_ROWS labelled rows, one for each doc_id; LEXICON entries and PHRASES exceptions, the
strongest; words of over LONGEST_WORD letters are no entries, their beginnings are. The summed weight counts up to MOST_WEIGHT.

Defined results. A null or empty text matches nothing and gets the curve's score for that. A very long text is matched
whole, in time linear in its length. Repeated rows are scored alike; a doc_id of any type will do; one with several labels
is toxic if one says so; null labels are left out; a row without a doc_id is not held out. Without labelled rows of both
kinds nothing is learned and every score is 0. An empty table gives no row. Of documents only doc_id and text are read,
of labels only doc_id and toxic.
"""

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from .common import sampled, settled

#: Labelled rows at most (about) that the lexicon and the curve are learned from.
TRAIN_ROWS = 8000
#: An entry stands in so many toxic training documents at least, in such a share of them, and so much more often than in others.
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 5, 0.02, 2.3
#: Times that a word counts in one training document, at most.
REPEATS = 3
#: Words of a shingle by which copies are known.
COPY_SHINGLE = 5
SHORTEST, LONGEST, LONGEST_WORD = 4, 9, 40
LEXICON, PHRASES = 2000, 500
#: Pairs of neighbours (the words before and after) between which toxic training documents have an entry, at least.
LEAST_CONTEXTS = 5
#: Tasks that read the sample.
SAMPLE_TASKS = 24
#: Largest summed weight that the curve tells apart.
MOST_WEIGHT = 100.0
#: Phrases in which a lexicon word is meant otherwise.
EXCEPTIONS = ("clown fish", "clown car", "trash can", "trash bin", "sore loser", "pond scum", "scum line")
#: Letters of other scripts that look like Latin ones, and digits that stand for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ß": "ss"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
HIDDEN = "­​‌‍⁠﻿"
_BETWEEN = re.compile(r"(?<=[a-z])[@$](?=[a-z])")
_BREAKS = re.compile(r"[\W_]+")


def _folds() -> dict[int, str | None]:
    """Accents by decomposition, full-width letters by offset, then the tables."""
    table: dict[int, str | None] = {c: b for c in range(0xC0, 0x250) if (b := unicodedata.normalize("NFD", chr(c))[0].lower()) != chr(c)}
    table |= {c: None for c in range(0x300, 0x370)} | {0xFF01 + i - 0x21 + 0: chr(i).lower() for i in range(0x21, 0x7F)}
    table |= {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()} | {ord(k.upper()): v for k, v in HOMOGLYPHS.items() if len(k.upper()) == 1 and ord(k.upper()) > 127}
    return table | dict.fromkeys(map(ord, HIDDEN))


FOLDS = _folds()


def folded(text: str) -> str:
    """Lower-case words with a space before, between and after."""
    text = text.lower().translate(FOLDS)
    if "@" in text or "$" in text:
        text = _BETWEEN.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return f" {_BREAKS.sub(' ', text).strip()} "


@dataclass
class Model:
    """weights: entries, which start with a space and end with one if they are whole words. curve: of the
    logistic function, over (1, matched weight by square root of words, matched weight)."""

    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-50.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = EXCEPTIONS

    def __post_init__(self):
        self._machine = None

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._machine.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                self._machine.add_word(folded(phrase), (len(folded(phrase)), None))
            self._machine.make_automaton()
        return self._machine

    def matched(self, text: str) -> tuple[float, int]:
        """Sum of weights, each word counted once by its heaviest entry, and the number of words."""
        line = folded(text)
        best, spared = {}, []
        if self.weights:
            for end, (n, weight) in self.machine().iter(line):
                start = end - n + 1
                if weight is None:
                    spared.append((start, end))
                elif weight > best.get(start, 0):
                    best[start] = weight
        if spared:
            spared.sort()
            starts, ends = [a for a, _ in spared], np.maximum.accumulate([b for _, b in spared]).tolist()
            best = {at: w for at, w in best.items() if not (k := bisect_right(starts, at)) or at >= ends[k - 1]}
        return sum(best.values()), max(line.count(" ") - 1, 1)

    def score(self, text: str) -> float:
        total, n = self.matched(text)
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * total / np.sqrt(n) + c * min(total, MOST_WEIGHT), -50, 50))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sketch(text: str) -> int:
    """The smallest hash of a folded text's five-word shingles: near copies mostly share it, other texts hardly ever."""
    from xxhash import xxh64_intdigest

    words = folded(text).split()
    least = min(xxh64_intdigest(" ".join(words[i : i + COPY_SHINGLE])) for i in range(max(1, len(words) - COPY_SHINGLE + 1)))
    return least - 2**63


@F.pandas_udf(LongType())
def _sketches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([sketch(t) for t in batch], dtype="int64")


def one_of_each(rows: DataFrame) -> DataFrame:
    """Of labelled rows that share a sketch and a label, the one with the smallest doc_id: a document that
    was copied a thousand times teaches no more than another."""
    kept = rows.withColumn("sketch", _sketches("text")).groupBy("sketch", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("row"))
    return kept.select("row.doc_id", "row.text", "toxic")


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text and toxic of a bounded sample of labelled rows that are not held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = sampled(settled(known), rows, "doc_id")
    # about `rows` rows of two numbers, so the documents need not move; repeats of a doc_id become one row
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def entries_of(line: str) -> Counter:
    """The whole words of a folded text and their beginnings, with how often they stand there; a word counts REPEATS times at most."""
    found = Counter()
    for w, k in Counter(line.split()).items():
        k = min(k, REPEATS)
        if len(w) <= LONGEST_WORD:
            found[f" {w} "] += k
        for n in range(SHORTEST, min(LONGEST, len(w)) + 1):
            found[f" {w[:n]}"] += k
    return found


def chosen(seen: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Of entries with how often toxic and clean rows have them, those that are kept, and their weights. The strongest come first;
    what begins with a kept entry is matched by it already, and a beginning of kept ones counts only where they don't match."""

    def odds(t: int, c: int) -> float:
        return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))

    kept = {}
    # of entries at the same places the longest, and of a word and its whole beginning the beginning
    for e in sorted(seen, key=lambda e: (-odds(*seen[e]) * math.sqrt(seen[e][0]), -len(e.strip()), e.endswith(" "), e)):
        if any(e.startswith(k) for k in kept):
            continue
        inside = [k for k in kept if k.startswith(e)]
        outer = [k for k in inside if not any(k != j and k.startswith(j) for j in inside)]
        t, c = (seen[e][i] - sum(seen[k][i] for k in outer) for i in (0, 1))
        if t >= max(LEAST_DOCS, LEAST_SHARE * toxic) and odds(t, c) >= LEAST_ODDS:
            kept[e] = odds(t, c)
    return kept


def learned(train: DataFrame) -> dict[str, float]:
    """Entries and weights. Documents and places are counted by entry and label: first within each batch, then by Spark."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs, toxic, clean = Counter(), Counter(), Counter()
            for text, label in zip(batch.text, batch.toxic, strict=True):
                found = entries_of(folded(text))
                (toxic if label == 1 else clean).update(found)
                if label == 1:
                    docs.update(found.keys())
            # an entry that no toxic document has can't be chosen, but may have been seen elsewhere
            keys = list(toxic.keys() | clean.keys())
            if keys:
                yield pd.DataFrame({"entry": keys, "n": [docs[k] for k in keys], "t": [toxic[k] for k in keys], "c": [clean[k] for k in keys]})

    n = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return {}
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1))
    sums = train.mapInPandas(counted, "entry string, n long, t long, c long").groupBy("entry").agg(*(F.sum(k).alias(k) for k in "ntc"))
    best = sums.filter(F.col("n") >= max(LEAST_DOCS, LEAST_SHARE * n[1])).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    found = {r["entry"]: (r["t"], r["c"]) for r in best.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "entry").limit(LEXICON).collect()}
    wide = spread(train, set(found))
    return chosen({k: v for k, v in found.items() if k in wide}, n[1], n[0])


def found_words(machine, text: str) -> Iterator[tuple[str, str, str, str]]:
    """Of each match of an entry in a folded text: entry, the word before, the entry's whole word, and the word after."""
    line = folded(text)
    for end, entry in machine.iter(line):
        start = end - len(entry) + 1
        stop = line.find(" ", start + 1)
        yield entry, line[line.rfind(" ", 0, start) + 1 : start], line[start + 1 : stop], line[stop + 1 : line.find(" ", stop + 1)]


def finder(entries):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for e in entries:
        machine.add_word(e, e)
    machine.make_automaton()
    return machine


def spread(train: DataFrame, entries: set[str]) -> set[str]:
    """The entries that toxic rows have between LEAST_CONTEXTS pairs of neighbours or more."""

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = finder(entries)
        for batch in batches:
            seen = {(e, f"{before} {after}") for text in batch.text for e, before, _, after in found_words(machine, text)}
            if seen:
                yield pd.DataFrame(sorted(seen), columns=["entry", "context"], dtype=object)

    if not entries:
        return set()
    pairs = train.filter("toxic = 1").select("text").mapInPandas(contexts, "entry string, context string").distinct()
    return {r["entry"] for r in pairs.groupBy("entry").count().filter(F.col("count") >= LEAST_CONTEXTS).collect()}  # at most LEXICON


def learned_exceptions(train: DataFrame, weights: dict[str, float]) -> tuple[str, ...]:
    """Words with an entry, alone or with a neighbour, that LEAST_DOCS clean rows have, and in no smaller share than toxic ones."""
    entries = sorted(weights)

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = finder(entries)
        for batch in batches:
            counts = {0: Counter(), 1: Counter()}
            for text, label in zip(batch.text, batch.toxic, strict=True):
                near = {p for _, before, word, after in found_words(machine, text) for p in ((word,), (before, word), (word, after)) if all(p)}
                counts[int(label == 1)].update(" ".join(p) for p in near)
            keys = sorted(counts[0].keys() | counts[1].keys())
            if keys:
                yield pd.DataFrame({"phrase": keys, "t": [counts[1][k] for k in keys], "c": [counts[0][k] for k in keys]})

    n = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    sums = train.mapInPandas(phrases, "phrase string, t long, c long").groupBy("phrase").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    mostly_clean = (F.col("c") >= LEAST_DOCS) & (F.col("c") * n[1] >= F.col("t") * n[0])
    return tuple(r["phrase"] for r in sums.filter(mostly_clean).orderBy(F.desc("c"), "phrase").limit(PHRASES).collect())


def fitted(points: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a little shrinkage, each halved until the loss falls: whole steps may run away where the
    rows separate well. No weight is negative: a further match never lowers a score."""
    x, use = np.column_stack([np.ones(len(points)), points]), [0, 1, 2]
    while True:
        a, w, shrink = x[:, use], np.zeros(len(use)), np.array([1e-6, 1e-2, 1e-2])[use]

        def loss(v, a=a, shrink=shrink):
            return np.logaddexp(0, a @ v).sum() - toxic @ (a @ v) + 0.5 * shrink @ v**2

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(shrink), a.T @ (toxic - p) - shrink * w)
            while np.abs(step).max() >= 1e-9 and loss(w + step) > loss(w):
                step = step / 2
            w = w + step
            if np.abs(step).max() < 1e-9:
                break
        if (w[1:] >= 0).all():
            return tuple(float(w[use.index(k)]) if k in use else 0.0 for k in range(3))
        use = [0, *(k for k, v in zip(use[1:], w[1:], strict=True) if v >= 0)]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    # bounded rows, but too much work for the one task that they would be
    sample = settled(one_of_each(training_rows(docs, labels, rows)).repartition(SAMPLE_TASKS, "doc_id"))
    model = Model(learned(sample))
    if not model.weights:
        return model
    model = Model(model.weights, exceptions=EXCEPTIONS + learned_exceptions(sample, model.weights))

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.matched(t) for t in batch.text]
            yield pd.DataFrame({"total": [a for a, _ in found], "n": [b for _, b in found], "toxic": batch.toxic})

    seen = sample.select("text", F.col("toxic").cast("long")).mapInPandas(points, "total double, n long, toxic long").toPandas()  # numbers of the bounded sample
    seen = seen.sort_values(["total", "n", "toxic"])
    model.curve = fitted(np.column_stack([seen.total / np.sqrt(seen.n), seen.total.clip(upper=MOST_WEIGHT)]), (seen.toxic == 1).to_numpy(float))
    return model


def scorer(model: Model):
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)(F.coalesce("text", F.lit(""))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score under 0.5."""
    return docs.filter(scorer(model)(F.coalesce(docs["text"], F.lit(""))) < 0.5)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, train(docs, labels))
