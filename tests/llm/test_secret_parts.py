"""Planted secrets through the query's path, a second implementation of the spans, and long texts."""

import re
import time

import numpy as np
import pytest

from helpers import prose
from lorescope.llm import secrets

LETTERS = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))


@pytest.fixture(scope="module")
def table(spark):
    return secrets.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def drawn(seed: int, n: int, size: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(LETTERS, size)) for _ in range(n)]


def plain_base(text: str) -> list[str]:
    """Character by character, without the operator's patterns."""
    words, found = ("password", "passwd", "secret", "token", "api_key", "apikey"), []
    value, lower = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"), "".join(c.lower() if c.isascii() else c for c in text)

    def run(at, chars):
        end = at
        while end < len(text) and text[end] in chars:
            end += 1
        return end

    def assign(at):
        for w in words:
            if lower.startswith(w, at):
                k = at + len(w)
                k += k < len(text) and text[k] in "\"'"
                k = run(k, " ")
                if k < len(text) and text[k] in ":=":
                    k = run(k + 1, " ")
                    k += k < len(text) and text[k] in "\"'"
                    if run(k, value) > k:
                        return k, run(k, value)

    at = 0
    while at < len(text):
        hit = assign(at)
        if hit:
            if hit[1] - hit[0] >= 12:
                found.append((at, 0, hit[1]))
            at = hit[1]
        else:
            at += 1
    for kind, head, chars, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18), (2, "", set("0123456789abcdef"), 16)):
        at = 0
        while at < len(text):
            end = run(at + len(head), chars) if text.startswith(head, at) else at
            if end > at + len(head):
                if end - at >= least:
                    found.append((at, kind, end))
                at = end
            else:
                at += 1
    return [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def plain_all(text: str, table) -> set[str]:
    """The base spans, and runs and parts by a mask of every character."""
    base = [s.split(":") for s in plain_base(text)]
    held = np.zeros(len(text) + 1, bool)
    for _, a, b in base:
        held[int(a) : int(b)] = True
    out = {":".join(s) for s in base}
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        if len(m[0]) < secrets.LEAST_RUN:
            continue
        if secrets.is_random(m[0], table):
            out.add(f"random:{m.start()}:{m.end()}")
        elif held[m.start() : m.end()].any():
            free = "".join("-" if h else "x" for h in held[m.start() : m.end()])
            for p in re.finditer("x+", free):
                a, b = m.start() + p.start(), m.start() + p.end()
                if b - a >= secrets.LEAST_RUN and secrets.is_random(text[a:b], table):
                    out.add(f"random:{a}:{b}")
    return out


def test_spans_equal_a_second_implementation(spark, table):
    keys = drawn(5, 40, 24)
    bits = ["password", "TOKEN=", "api_key: ", "apikey", "secret", "AKIA", "AKIAABCDEFGH2345678", "0123456789abcdef", "deadbeefdeadbeef00", "=", ":", " ", "'", "\n", "😀", "ſecret=abcdefghijklmnop", "ordinary_thing", *keys[:8]]
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(bits, 14)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000", "text"))
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in secrets.scan(docs, table).collect():
        told = [*filter(None, r["spans"].split(","))]
        assert [s for s in told if not s.startswith("random")] == plain_base(held[r["doc_id"]])
        assert len(told) == len(set(told)) and set(told) == plain_all(held[r["doc_id"]], table)


def test_planted_secrets_without_a_pattern(spark, table):
    """Keys of 12 to 48 letters and digits in prose are found by the model alone, in the query's result."""
    shares = {}
    for size in (12, 16, 24, 48):
        keys = drawn(size, 200, size)
        docs = spark.createDataFrame([(i, f"{prose(i, 30)} {k} {prose(i + 900, 30)}") for i, k in enumerate(keys)], "doc_id long, text string")
        rows = secrets.scan(docs, table).collect()
        shares[size] = np.mean([r["spans"].startswith("random:") for r in rows])
        assert all(r["n_assign"] == r["n_access"] == r["n_hex"] == 0 for r in rows)
        clean = [r["text"] for r in secrets.redacted(docs, table).collect()]
        assert np.mean([k in t for k, t in zip(keys, clean, strict=True)]) == pytest.approx(1 - shares[size])
    assert shares[12] > 0.7 and shares[16] > 0.9 and shares[24] > 0.97 and shares[48] > 0.99, shares


def test_parts_beside_a_base_span(table):
    for sign in "/=":
        keys = drawn(11, 100, 40)
        texts = [f"id AKIA{'ABCDEFGH23456789'}{sign}{k} end" for k in keys]
        left = [secrets.redact(t, secrets.all_spans(t, table)) for t in texts]
        assert np.mean([k in t for k, t in zip(keys, left, strict=True)]) < 0.05
    mixed = [f"{a}0123456789abcdef{b}" for a, b in zip(drawn(1, 100, 24), drawn(2, 100, 24), strict=True)]
    left = [secrets.redact(t, secrets.all_spans(t, table)) for t in mixed]
    assert np.mean([not re.search("[A-Za-z0-9]{12}", t) for t in left]) > 0.9
    plain = "the_thin_thing_then/0123456789abcdef/another_ordinary_thing"
    assert [s[2] for s in secrets.all_spans(plain, table)] == ["hex"]
    assert [s[2] for s in secrets.all_spans("the_thin_thing_then/0123456789abcdef/" + drawn(3, 1, 30)[0], table)].count("random") == 1


def test_time_is_linear(table):
    pair = "token = 0123456789abcdef0123 key_of_a_thing/another_ordinary_thing "
    took = []
    for n in (10_000, 160_000):
        began = time.time()
        assert len(secrets.all_spans(pair * n, table)) >= 2 * n
        took.append(time.time() - began)
    assert took[1] < 40 * max(took[0], 0.05)
