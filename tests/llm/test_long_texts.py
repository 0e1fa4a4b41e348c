"""One text of five megabytes goes whole through every operator and stage, and pictures get plain hashes."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SCHEMA, prose
from lorescope.llm import license_scan, media, mixing, near_copies, packing, quality_classifier, quality_rules, secrets, simhash, toxicity

KEY = "q7Zt0PbX4mVd9KcR2nLw8HsJ5yGf3TeA"
N = 40


@pytest.fixture(scope="module")
def long_docs(spark):
    part = " ".join(prose(i, 700) for i in range(N)) + "\n"
    text = part * (5_000_000 // len(part) + 1) + f"{license_scan.NOTICES['MIT']} {KEY} the end"
    rows = [(1, text, "en", "a", len(text)), (2, prose(1, 90), "en", "a", 1), (3, text, "en", "a", len(text))]
    return text, spark.createDataFrame(rows, SCHEMA).repartition(2, "doc_id")


def test_every_operator_takes_it_whole(spark, long_docs):
    text, docs = long_docs
    n, of = len(text.split()), lambda df: {r["doc_id"]: r for r in df.collect()}
    assert len(text) > 5_000_000
    assert {r["doc_id"] for r in license_scan.matches(docs).filter("license = 'MIT'").collect()} == {1, 3}
    pieces = packing.pack(packing.tokenize(docs)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert all(p["n"] == p["all"] for p in pieces) and max(p["all"] for p in pieces) > n
    assert of(mixing.mix(docs))[1]["size"] == n
    spans = of(secrets.scan(docs, secrets.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))))
    assert f"random:{len(text) - len(KEY) - 8}:{len(text) - 8}" in spans[1]["spans"]
    model = toxicity.Model({" the ": 2.0}, (-1.0, 1.0, 1.0))
    assert of(toxicity.scored(docs, model))[1]["score"] > of(toxicity.scored(docs, model))[2]["score"]
    assert len(of(quality_classifier.voted(docs))) == 3 and of(quality_classifier.voted(docs))[1]["votes"][4] == 0
    tops = of(simhash.near_duplicates(docs))
    assert tops[3]["component_id"] == 1 and tops[2]["component_id"] == 2
    assert of(media.decoded(media.encoded(docs)))[1]["payload_bytes"] == len(media.padded(text)[0])
    assert of(quality_rules.judged(docs))[1]["n_words"] == n and of(quality_rules.judged(docs))[1]["base_failed"]
    assert {r["doc_id"] for r in near_copies.deduplicated(docs).collect()} == {1, 2}


def plain_hash(image) -> bytes:
    """Cell by cell and wave by wave."""
    height, width, _ = image.shape
    grid = np.zeros((32, 32))
    edge = lambda k, n: k * n // 32
    for y in range(32):
        for x in range(32):
            ys = range(edge(y, height), max(edge(y + 1, height), edge(y, height) + 1))
            xs = range(edge(x, width), max(edge(x + 1, width), edge(x, width) + 1))
            grid[y, x] = np.mean([image[b, a] for b in ys for a in xs])
    low = [sum(grid[y, x] * np.cos(np.pi * (y + 0.5) * v / 32) * np.cos(np.pi * (x + 0.5) * u / 32) for y in range(32) for x in range(32)) for v in range(8) for u in range(8)]
    low = [round(float(a), 6) for a in low]
    middle = sorted(low[1:])[31]
    return bytes(int("".join("1" if a > middle else "0" for a in low[k : k + 8]), 2) for k in range(0, 64, 8))


@pytest.mark.parametrize("words", [3, 40, 900])
def test_features_equal_plain_ones(words):
    payload, _ = media.padded(prose(words, words))
    image = media.decode(media.encode(payload))
    assert media.image_hash(image) == plain_hash(image)


def test_headers_and_chunks_are_held_to_the_format():
    png = media.encode(media.padded(prose(1, 300))[0])
    parts = list(media.chunks(png))
    build = lambda found: media.SIGNATURE + b"".join(media._chunk(k, b) for k, b in found)
    assert build(parts) == png
    head = struct.unpack(">IIBBBBB", parts[0][1])
    for at in (4, 5, 6):
        wrong = [*head]
        wrong[at] = 1
        with pytest.raises(ValueError):
            media.decode(build([(b"IHDR", struct.pack(">IIBBBBB", *wrong)), *parts[1:]]))
    body = parts[1][1]
    split = [parts[0], (b"IDAT", body[:50]), (b"IDAT", body[50:]), parts[-1]]
    assert (media.decode(build(split)) == media.decode(png)).all()
    with pytest.raises(ValueError):
        media.decode(build([split[0], split[1], (b"tEXt", b"a\0b"), split[2], split[3]]))
    with pytest.raises(ValueError):
        media.decode(build([parts[0], parts[-1]]))
