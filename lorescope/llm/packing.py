"""Packing by concatenating and cutting.

Pass 1 turns each document into token ids and writes them with the document's place in its
partition. The partitions' totals, one row each, are prefix-summed into global offsets. Pass 2 cuts
the stream into windows of a fixed length; a document that crosses a window's edge gives a piece
(boundary record) on either side. No token crosses the network.

Defined results. A null text is empty: one piece with the end id alone. Repeated rows are packed
as often as they come. An empty table gives no piece. Very long texts are tokenized whole and cut into as many
pieces as they need. Other columns are ignored, whatever their names.
"""

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import shared_dir

LENGTH = 2048
END_ID = 1
#: Word to ids, kept by each Python worker; the words that come first (so, the frequent ones) stay.
CACHE_ENTRIES = 400_000
#: White space as the tokenizers' pattern has it: a unit is such a run and what follows to the next.
_BLANK = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_UNIT = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
_SPECIAL = re.compile(r"(<\|endoftext\|>)")


class _Ids:
    """Text to little-endian unsigned 32-bit ids, unit by unit: no token of this vocabulary's
    pattern reaches over the end of a unit, so that ids of a unit can be kept and joined."""

    def __init__(self, ranks_file: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.special = np.array([len(ranks)], "<u4").tobytes()
        self.encode = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def unit(self, s: str) -> bytes:
        ids = np.array(self.encode(s), "<u4").tobytes()
        if len(self.known) < CACHE_ENTRIES and len(s) < 40:
            self.known[s] = ids
        return ids

    def plain(self, text: str) -> bytes:
        known = self.known.get
        return b"".join([known(s) or self.unit(s) for s in _UNIT.findall(text)])

    def __call__(self, text: str) -> bytes:
        if "<|endoftext|>" not in text:
            return self.plain(text)
        return b"".join(self.special if s == "<|endoftext|>" else self.plain(s) for s in _SPECIAL.split(text))


_ids: dict[str | None, _Ids] = {}


def encoder(ranks_file: str | None = None) -> _Ids:
    """One encoder for each worker process."""
    if ranks_file not in _ids:
        _ids[ranks_file] = _Ids(ranks_file)
    return _ids[ranks_file]


def tokenize(docs: DataFrame, ranks_file: str | None = None, end_id: int = END_ID, slice_rows: int = 64) -> DataFrame:
    """Write (doc_id, part, start, n, ids) to the shared folder and read it again: `start` is the
    document's first token in its partition, `ids` its little-endian 32-bit ids with the end id."""

    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, at = encoder(ranks_file), TaskContext.get().partitionId(), 0
        for whole in batches:
            for k in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(k, slice_rows)
                ids = [ids_of(t or "") + end for t in batch.column(1).to_pylist()]
                n = np.array([len(x) // 4 for x in ids], "int64")
                start = at + np.concatenate([[0], np.cumsum(n)[:-1]]).astype("int64")
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, "int64")), pa.array(start), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "part", "start", "n", "ids"])

    spark = docs.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, part long, start long, n long, ids binary").write.option("compression", "zstd").parquet(at)
    return spark.read.parquet(at)


def pack(tokens: DataFrame, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Cut the concatenation of tokenize()'s rows into sequences of `length` ids.

    One row for each piece: where it starts in its document, where it lies in its sequence. Every
    sequence but the last is full. with_ids adds the piece's ids, and document_at, where its document starts in the
    whole stream: rows of tokens that share a doc_id (a mix repeats and cuts documents) differ in it.
    """
    totals = tokens.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("total"))
    # one row for each task that wrote tokens, so both the window and the broadcast stay small
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = tokens.join(F.broadcast(bases), "part").withColumn("g", F.col("base") + F.col("start"))

    def piece(s):
        first = F.greatest(s * length - F.col("g"), F.lit(0))
        last = F.least((s + 1) * length - F.col("g"), F.col("n"))
        cut = F.substring(F.col("ids"), (first * 4 + 1).cast("int"), ((last - first) * 4).cast("int"))
        fields = [first.alias("start"), (last - first).alias("length"), F.crc32(cut).alias("ids_crc32"), s.alias("sequence_id"), (F.col("g") + first - s * length).alias("offset")]
        return F.struct(*fields, *([cut.alias("ids")] if with_ids else []))

    spans = F.sequence(F.floor(F.col("g") / length), F.floor((F.col("g") + F.col("n") - 1) / length))
    at = [F.col("g").alias("document_at")] if with_ids else []
    return placed.select("doc_id", F.col("n").alias("doc_tokens"), *at, F.explode(F.transform(spans, piece)).alias("piece")).select("doc_id", "doc_tokens", *(["document_at"] if with_ids else []), "piece.*")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(tokenize(docs)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
