"""Secret scans: character Markov models by log-likelihood ratio, and fixed patterns beside them.

Two first-order models are trained: one of random strings, one of ordinary identifiers. A run of identifier
characters is a secret of kind `random` if the log-likelihood ratio of the models, per character and as a whole, is
high; of a run that isn't, the parts that the patterns leave are judged alone, so that a key glued to a plain word or
to a patterned secret is found. The patterns' own spans always stay, and the model's may overlap them. Training
strings come labelled: random ones are drawn by hash in the usual alphabets, ordinary ones are the words of a sample
of documents (SAMPLE_DOCS), joined as identifiers are. Counting transitions is a Spark aggregation with at most 96 * 96 results a label.

Runs and patterns are swept once in order, so the time is linear in a text's length, also for texts of many megabytes.

Defined results. A null or empty text has no span. Repeated rows are scanned alike, an empty table
gives no row, and only doc_id and text are read.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import sampled

#: Patterns and least lengths of the three kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
#: The model's own kind: runs of at least so many of these characters.
LEAST_RUN = 12
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
RANDOM = "random"
LEAST_RATIO, LEAST_TOTAL = 0.6, 12.0
SAMPLE_DOCS = 500
RANDOM_STRINGS = 4000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns by start, then kind; offsets are code points, the end exclusive."""
    spans = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(spans, key=lambda s: (s[0], s[2]))]


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """Strings that look drawn at random, in hexadecimal of either case, base 64 and upper-case alphanumerics."""
    digest = F.sha2(F.concat(F.lit("random-"), F.col("id").cast("string")), 256)
    coded = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    capital = F.translate(F.upper(coded), "+/", "QZ")
    return spark.range(n).select(F.element_at(F.array(digest, F.upper(digest), coded, capital), (F.col("id") % 4 + 1).cast("int")).alias("s"))


def ordinary_strings(docs: DataFrame, rows: int = SAMPLE_DOCS) -> DataFrame:
    """The different words of a bounded sample of documents, joined as identifiers are, in either case."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[0-9a-fA-F]{16,}|AKIA[A-Z0-9]+", " ")
    found = sampled(docs.select("doc_id", "text"), rows, "doc_id", "text").select(F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("s")).distinct()
    joined = F.concat("s", F.lit("_"), "s", F.lit("-"), "s", F.lit("/"), "s", F.initcap("s"))
    return found.select(F.explode(F.array(joined, F.upper(joined))).alias("s"))


def transitions(strings: DataFrame) -> dict[tuple[str, str], int]:
    """How often a character follows another."""
    chars = F.filter(F.split("s", ""), lambda c: c != "")
    pairs = strings.select(F.explode(F.zip_with(chars, F.slice(chars, 2, 2**30), lambda a, b: F.concat(a, b))).alias("p")).filter("length(p) = 2")
    return {(r["p"][0], r["p"][1]): r["count"] for r in pairs.groupBy("p").count().collect()}  # at most 96 * 96 rows


def train(docs: DataFrame, rows: int = SAMPLE_DOCS) -> np.ndarray:
    """128 x 128 log-likelihood ratios of a transition: random against ordinary."""
    logs = []
    for found in (transitions(random_strings(docs.sparkSession)), transitions(ordinary_strings(docs, rows))):
        m = np.full((128, 128), 0.5)
        for (a, b), n in found.items():
            if ord(a) < 128 and ord(b) < 128:
                m[ord(a), ord(b)] += n
        # rows that are seldom seen lean to the whole table's characters
        back = m.sum(axis=0) / m.sum()
        m += 20 * back
        logs.append(np.log(m / m.sum(axis=1, keepdims=True)))
    return (logs[0] - logs[1]).astype("float32")


def ratio(run: str, table: np.ndarray) -> tuple[float, float]:
    """Log-likelihood ratio of a run: for a character, and in total."""
    codes = np.frombuffer(run.encode("ascii"), "u1")
    total = float(table[codes[:-1], codes[1:]].sum())
    return total / (len(codes) - 1), total


def is_random(run: str, table: np.ndarray) -> bool:
    each, total = ratio(run, table)
    return each >= LEAST_RATIO and total >= LEAST_TOTAL


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What spans (sorted by start) cover, as intervals that don't touch."""
    out: list[tuple[int, int]] = []
    for a, b, _ in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def model_spans(text: str, table: np.ndarray, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Runs that the models take for random, or else such parts of them as spans leave."""
    covered, at = merged(spans), 0
    for m in RUN.finditer(text):
        start, end = m.span()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if is_random(m[0], table):
            yield start, end, RANDOM
            continue
        k = at
        while k < len(covered) and covered[k][0] < end:
            if covered[k][0] - start >= LEAST_RUN and is_random(text[start : covered[k][0]], table):
                yield start, covered[k][0], RANDOM
            start = covered[k][1]
            k += 1
        if k > at and end - start >= LEAST_RUN and is_random(text[start:end], table):
            yield start, end, RANDOM


def all_spans(text: str, table: np.ndarray) -> list[tuple[int, int, str]]:
    """The base spans and the model's, by start, then kind."""
    spans = base_spans(text)
    found = [*model_spans(text, table, spans)]
    return sorted(spans + found, key=lambda s: s[0]) if found else spans


def _told(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id, counts of each base kind, digest of the base spans, and all spans."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                spans = all_spans(t, table)
                base = [s for s in spans if s[2] != RANDOM]
                kinds = [k for *_, k in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", scanned(F.coalesce("text", F.lit(""))).alias("f")).select("doc_id", "f.*")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span, joined with those it overlaps, replaced by its kind."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """The same rows with secrets replaced; a null text stays null; n_chars, if there, follows."""

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([None if t is None else redact(t, all_spans(t, table)) for t in batch], dtype=object)

    names = docs.columns
    out = docs.withColumn("text", clean("text"))
    kept = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None
    return out.select(*[kept.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names])


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs))
