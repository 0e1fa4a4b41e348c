"""The last stage's rows hold the tokens themselves."""

import zlib

import numpy as np

import corpus_pipeline
from helpers import SCHEMA, prose


def test_packed_rows_hold_the_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = {i: prose(i, 400 + 300 * i) for i in range(6)}
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in texts.items()], SCHEMA)
    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    held = {}
    for p in dict(corpus_pipeline.STAGES)["packing"](spark, docs, "").orderBy("doc_id", "start").collect():
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
        held[p["doc_id"]] = held.get(p["doc_id"], []) + ids
    assert held == {d: [*reader.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
