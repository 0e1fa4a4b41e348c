"""corpus_pipeline.run() against the same five steps in plain Python, on small tables."""

import hashlib
import math
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from lorescope.llm import secrets, toxicity
from test_near_copies import plain_kept
from test_results import shared_out

SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_mix(docs: list[dict]) -> list[tuple[int, str]]:
    sizes = Counter()
    for d in docs:
        sizes[d["source"]] += len(WORD.findall(d["text"]))
    goals, out = shared_out(dict(sizes)), []
    for source, goal in goals.items():
        budget, size = round(goal), sizes[source]
        epochs, rest = divmod(budget, size) if size else (0, 0)
        keyed = []
        for d in docs:
            if d["source"] == source:
                u = (int(hashlib.md5(f"mix-1{d['doc_id']}".encode()).hexdigest()[:12], 16) + 1) / 2**48
                marks = sum(c in "#*$%&|<>" for c in d["text"])
                weight = max(0.25, 1 / (1 + 20 * (marks / max(len(d["text"]), 1))))
                keyed.append((-math.log(u) / weight, d["doc_id"], d["text"]))
        for _, doc_id, text in sorted(keyed):
            out += [(doc_id, text)] * epochs
            ends = [m.end() for m in WORD.finditer(text)]
            if rest >= len(ends) > 0:
                out.append((doc_id, text))
            elif rest > 0:
                out.append((doc_id, text[: ends[rest - 1]]))
            rest = max(0, rest - len(ends))
    return out


def test_run_equals_plain_steps(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = [r.asDict() for r in docs.collect() if model.score(r["text"]) < 0.5]
    assert 0 < len(rows) < docs.count()
    stay = plain_kept({r["doc_id"]: r["text"] for r in rows})
    rows = [r for r in rows if r["doc_id"] in stay]
    table = secrets.train(spark.createDataFrame(rows, docs.schema))
    for r in rows:
        r["text"] = secrets.redact(r["text"], secrets.all_spans(r["text"], table))
    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, total = Counter(), 0
    for doc_id, text in plain_mix(rows):
        n = len(reader.encode(text, add_special_tokens=False).ids) + 1
        want[doc_id, n] += 1
        total += n
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    found = Counter((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0)
    assert (found - want, want - found) == (Counter(), Counter())
    assert sum(p["length"] for p in pieces) == total
    # the stream, rebuilt from the rows alone, holds each repeat of a document whole
    stream, copies = {}, {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        stream.setdefault(p["sequence_id"], []).extend(np.frombuffer(p["ids"], "<u4").tolist())
        copies.setdefault((p["document_at"], p["doc_id"]), []).extend(np.frombuffer(p["ids"], "<u4").tolist())
    assert sum(map(len, stream.values())) == total
    held = Counter((d, tuple(ids)) for (_, d), ids in copies.items())
    assert held == Counter((d, (*reader.encode(t, add_special_tokens=False).ids, 1)) for d, t in plain_mix(rows))
    filled = Counter()
    for p in pieces:
        filled[p["sequence_id"]] += p["length"]
    assert sorted(filled) == list(range(-(-total // 2048))) and set(np.array([filled[s] for s in sorted(filled)])[:-1]) == {2048}
