"""Directly addressable codes against plain lists of ids, and the files against the plain tokenizer."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from helpers import SCHEMA, awkward, prose, rows
from lorescope.llm import token_codes as codes


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


RANDOM = np.random.default_rng(5)
STREAMS = {
    "none": [],
    "zero": [0],
    "end": [2],
    "short": list(range(512)),
    "one value": [7] * 1025,
    "edge of the directory": RANDOM.integers(0, 600, 1024).tolist(),
    "vocabulary": RANDOM.integers(0, 49408, 5000).tolist(),
    "mostly small": np.where(RANDOM.random(4096) < 0.7, RANDOM.integers(0, 200, 4096), RANDOM.integers(0, 49408, 4096)).tolist(),
    "all bits": RANDOM.integers(0, 2**32, 3000, dtype="u8").tolist(),
}


@pytest.mark.parametrize("name", STREAMS)
def test_codes(name):
    ids = STREAMS[name]
    segment = codes.Segment(codes.encode(np.array(ids, "u4")), check=True)
    assert segment.ids().tolist() == ids == [segment[i] for i in range(len(ids))]
    for _ in range(100):
        a, b = sorted(RANDOM.integers(0, len(ids) + 1, 2))
        assert segment.ids(a, b).tolist() == ids[a:b]
    with pytest.raises(IndexError):
        segment[len(ids)]


def test_widths_are_the_cheapest():
    """No other choice of up to four levels takes fewer bits; small ids take one level of few bits."""
    from itertools import product

    ids = np.array(STREAMS["mostly small"], "u4")
    size = lambda widths: sum(int(np.count_nonzero(ids >> s)) * (w + (1 + 32 / codes.RANK) * (s + w < 16)) if s else len(ids) * (w + (1 + 32 / codes.RANK) * (w < 16)) for s, w in zip(np.cumsum([0, *widths]), widths))
    best = codes.best_widths(ids)
    assert size(best) <= min(size(w) for k in (1, 2, 3, 4) for w in product(codes.WIDTHS, repeat=k) if 16 <= sum(w) and sum(w[:-1]) < 16) + 1e-6
    assert codes.best_widths(np.full(50, 3)) == [2]


def test_one_id_touches_few_bytes():
    """Every byte but those of the id's chunks, marks and ranks may be lost."""
    ids = np.array(STREAMS["mostly small"], "u4")
    whole = codes.encode(ids)
    head = len(whole) - sum(len(x) * x.itemsize for level in codes.Segment(whole).levels for x in level if x is not None)
    for i in (0, 5, 511, 512, 2049, 4095):
        need = set()
        for k in range(head, len(whole), 7):
            broken = bytearray(whole)
            broken[k] ^= 255
            if codes.Segment(bytes(broken))[i] != ids[i]:
                need.add(k)
        assert len(need) <= 2 * (2 + codes.RANK // 8 + 4)
    with pytest.raises(ValueError):
        codes.Segment(whole[:-1] + bytes([whole[-1] ^ 1]), check=True)
    with pytest.raises(ValueError):
        codes.Segment(b"PNG" + whole)


ODD = ["", " \n\t ", "ΣΑΣ ΑΣ. Σ", "é ́x ạ́ `", "a\x85b c\x1cd <|endoftext|> x<|startoftext|>y it's I'LL 12 3 k", "İ ı ﬁ ǅ ͅ \u0000 x", "don't\t\x0b\x0c\r\n'S 's ,'s 1's", "한국어 ガ ゙ a", "<|ENDOFTEXT|> a<|endoftext|>b", "ABC123,def x_y [[a]]..b 1a2 <|endoftext", "ÀÉß ÿ×÷ º1ª µm µµ ½a² Ñandú,éÉ\xa0x", "H̱ẖ Åå"]


def test_words_are_the_tokenizer(plain):
    known = codes.words()
    for text in ODD + [prose(i, 300) for i in range(20)]:
        assert known.of(pa.array([text]))[0].tolist() == plain(text), text
    ids, sizes = known.of(pa.array([*ODD, None]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain(t) for t in [*ODD, ""]]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x3FF), max_size=40))
def test_any_text_is_the_tokenizer(text):
    known = codes.words()
    assert known.of(pa.array([text]))[0].tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids


def brute(docs, plain):
    """Documents by id, nulls first, and the whole stream; rows of one id may stand in any order."""
    return sorted(((r["doc_id"], [*plain(r["text"] or ""), 2]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))


@pytest.mark.parametrize("segment_ids", [5, 100, codes.SEGMENT_IDS])
def test_files(spark, plain, segment_ids):
    docs = awkward(spark).repartition(3)
    want = brute(docs, plain)
    path = codes.write(docs, segment_ids=segment_ids)
    got = codes.documents(spark, path).orderBy("start").collect()
    assert sorted((repr(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == sorted((repr(i), t) for i, t in want)
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]) // 4) and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]
    stream = [t for r in got for t in np.frombuffer(r["ids"], "<u4").tolist()]
    asked = [0, 1, len(stream) // 2, len(stream) - 1, len(stream), -1]
    assert rows(codes.tokens_at(spark, path, asked)) == [(p, stream[p]) for p in sorted(asked) if 0 <= p < len(stream)]
    assert codes.tokens_at(spark, path, []).count() == 0
    assert rows(codes.documents(spark, path, with_ids=False)) == rows(codes.documents(spark, path).drop("ids"))
    clash = awkward(spark, True)
    for c in ("tie", "at", "codes", "base", "total", "lengths"):
        clash = clash.withColumn(c, clash["source"])
    assert rows(codes.documents(spark, codes.write(clash)).select("doc_id", "n_tokens", "ids_crc32")) == rows(codes.documents(spark, path).select("doc_id", "n_tokens", "ids_crc32"))


def test_nothing_and_long_texts(spark, plain):
    assert codes.documents(spark, codes.write(spark.createDataFrame([], SCHEMA))).count() == 0
    long = prose(3, 700) + " "
    long *= 5_000_000 // len(long) + 1
    docs = spark.createDataFrame([(2, long, "en", "a", 1), (1, "x" * 1_000_000, "en", "a", 1), (3, "a b", "en", "a", 1)], SCHEMA)
    got = codes.documents(spark, codes.write(docs)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [1, 2, 3]
    assert np.frombuffer(got[1]["ids"], "<u4").tolist() == [*plain(long), 2] and np.frombuffer(got[2]["ids"], "<u4").tolist() == [*plain("a b"), 2]


def test_one_id_on_most_rows_fills_no_task(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("the same text").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = codes.write(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = spark.read.parquet(path).groupBy("part").agg(F.sum(F.size("doc_ids")).alias("n")).collect()
    assert len(found) == 4 and max(r["n"] for r in found) < 2000
    assert codes.documents(spark, path, with_ids=False).count() == 4000
