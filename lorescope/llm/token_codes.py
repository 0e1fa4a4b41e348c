"""Token ids in files of directly addressable codes.

Documents are put in ascending order of doc_id and turned into ids. A segment holds the ids of whole documents.
Its ids are cut into chunks, low bits first: level 0 has a chunk of every id, each further level the next chunk of
those ids that have bits left. A bitmap for each level but the last tells which ids go on, and a directory of ranks
(ones before every RANK bits) gives an id's place in the next level. So an id is found from a few bytes of each level,
and no block is decoded. Chunk widths are those that take the fewest bits for the segment's ids.

A file is uncompressed Parquet with a row for each segment: part and at (the segment's first id in its part), n_ids,
doc_ids and lengths of its documents, codes. Parts follow one another in the order of doc_id; a
part's first id in the whole stream is the sum of what stands before it.

Defined results. A null text is empty: the end id alone. Null doc_ids come first, equal ones are ordered by their texts'
hash, and repeated rows are written as often as they come. A text of any length is one document of one segment.
Empty tables give no segment. Only doc_id and text are read. Damaged codes raise ValueError.
"""

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import shared_dir

END_ID = 2
#: A segment is closed when it has this many ids.
SEGMENT_IDS = 1 << 18
#: Bits of a bitmap for each entry of its directory of ranks; widths that a chunk can have.
RANK = 512
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16)
#: Pieces kept with their ids by each Python worker; those that come first (so, the frequent ones) stay.
CACHE_ENTRIES = 800_000
MAGIC = b"DAC1"
#: What keeps a text from being parted into runs: characters from U+0100 on, three letters among the signs below,
#: apostrophes and special tokens. Then the borders of runs of lower-case letters.
_ODD = "[^\\x00-\u00ff]|[\u00aa\u00b5\u00ba']|<\\|"
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_BORDERS = ("([a-zß-öø-ÿ])([^a-zß-öø-ÿ\\s])", "([^a-zß-öø-ÿ\\s])([a-zß-öø-ÿ])")


def best_widths(ids: np.ndarray) -> list[int]:
    """Chunk widths that take the fewest bits, bitmaps and directories included."""
    longest = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    over = [int(np.count_nonzero(ids >> s)) if s else len(ids) for s in range(longest)]  # ids with bits beyond s
    cost: list[tuple[float, list[int]]] = [(0.0, [])] * (longest + 1)
    for s in range(longest - 1, -1, -1):
        found = []
        for width in WIDTHS:
            mark = 1 + 32 / RANK if s + width < longest else 0
            found.append((over[s] * (width + mark) + cost[min(s + width, longest)][0], [width, *cost[min(s + width, longest)][1]]))
        cost[s] = min(found)
    return cost[0][1]


def _group(width: int) -> tuple[int, int]:
    """Chunks that fill whole bytes and at most eight, and those bytes."""
    n = 8 if width <= 8 else 4
    return n, n * width // 8


def _packed(chunks: np.ndarray, width: int) -> bytes:
    n, size = _group(width)
    padded = np.zeros(-(-len(chunks) // n) * n, "u8")
    padded[: len(chunks)] = chunks
    groups = np.zeros(len(padded) // n, "<u8")
    for k in range(n):
        groups |= padded[k::n] << np.uint64(k * width)
    return groups.view("u1").reshape(-1, 8)[:, :size].tobytes()


def _unpacked(data: np.ndarray, first: int, last: int, width: int) -> np.ndarray:
    """Chunks first to last; only the bytes of their groups are touched."""
    n, size = _group(width)
    start, end = first // n, -(-last // n)
    groups = np.zeros((end - start, 8), "u1")
    groups[:, :size] = data[start * size : end * size].reshape(-1, size)
    words, out = groups.view("<u8").ravel(), np.empty((end - start, n), "u4")
    for k in range(n):
        out[:, k] = words >> np.uint64(k * width) & np.uint64((1 << width) - 1)
    return out.ravel()[first - start * n : last - start * n]


def encode(ids: np.ndarray) -> bytes:
    """The codes of a segment: magic, number of ids, widths, checksum, then each level's chunks, bitmap and directory."""
    ids = np.asarray(ids, "u4")
    widths, rest, shift, body, sizes = best_widths(ids), ids, 0, [], []
    for k, width in enumerate(widths):
        sizes.append(len(rest))
        body.append(_packed(rest & ((1 << width) - 1), width))
        if k + 1 < len(widths):
            rest = rest >> width
            more = rest > 0
            ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, max(1, len(more)), RANK), dtype="u4"))[:-1]]) if len(more) else np.zeros(1)
            body += [np.packbits(more, bitorder="little").tobytes(), ranks.astype("<u4").tobytes()]
            rest = rest[more]
    data = b"".join(body)
    return MAGIC + struct.pack(f"<QB{len(widths)}B{len(widths)}QI", len(ids), len(widths), *widths, *sizes, zlib.crc32(data)) + data


class Segment:
    """Codes of encode(), read in place. segment[i] is an id; ids(first, last) are the ids of a span."""

    def __init__(self, codes: bytes, check: bool = False):
        if codes[:4] != MAGIC:
            raise ValueError("no codes")
        self.n, levels = struct.unpack_from("<QB", codes, 4)
        *numbers, crc = struct.unpack_from(f"<{levels}B{levels}QI", codes, 13)
        self.widths, sizes = numbers[:levels], numbers[levels:]
        at = 13 + struct.calcsize(f"<{levels}B{levels}QI")
        if check and zlib.crc32(memoryview(codes)[at:]) != crc:
            raise ValueError("codes are damaged")
        raw, self.levels = np.frombuffer(codes, "u1"), []
        for k, (width, size) in enumerate(zip(self.widths, sizes, strict=True)):
            n, whole = _group(width)
            bits = (-(-size // n) * whole * 8, size, 32 * max(1, -(-size // RANK)))[: 3 if k + 1 < levels else 1]
            parts = [raw[at : (at := at + -(-n // 8))] for n in bits]
            self.levels.append((parts[0], parts[1], np.frombuffer(parts[2].tobytes(), "<u4")) if k + 1 < levels else (parts[0], None, None))

    def _rank(self, level: int, i: int) -> int:
        """Ids before i that go on to the next level."""
        _, marks, ranks = self.levels[level]
        if i // RANK >= len(ranks):  # i is the end, at the edge of the directory
            return int(ranks[-1]) + int.from_bytes(marks[(len(ranks) - 1) * RANK // 8 :].tobytes(), "little").bit_count()
        inside = int.from_bytes(marks[i // RANK * (RANK // 8) : i // 8 + 1].tobytes(), "little")
        return int(ranks[i // RANK]) + (inside & ((1 << i % RANK) - 1)).bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for k, width in enumerate(self.widths):
            chunks, marks, _ = self.levels[k]
            window = int.from_bytes(chunks[i * width // 8 : i * width // 8 + 4].tobytes(), "little")
            value |= (window >> i * width % 8 & (1 << width) - 1) << shift
            if marks is None or not marks[i // 8] >> i % 8 & 1:
                break
            i, shift = self._rank(k, i), shift + width
        return value

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        first, last = int(first), self.n if last is None else int(last)
        out, places, shift = np.zeros(last - first, "u4"), slice(None), 0
        for k, width in enumerate(self.widths):
            chunks, marks, _ = self.levels[k]
            out[places] |= _unpacked(chunks, first, last, width) << np.uint32(shift)
            if marks is None or first == last:
                break
            more = np.flatnonzero(np.unpackbits(marks[first // 8 : -(-last // 8)], bitorder="little")[first % 8 : first % 8 + last - first])
            places, shift = places[more] if k else more, shift + width
            first, last = self._rank(k, first), self._rank(k, last)
        return out


class _Words:
    """Texts to ids by the tokenizer, each piece once.

    The tokenizer drops white space, its pattern matches none, and its normal form joins nothing across an ASCII blank, so that a text's
    ids are those of its words, one after another. Without apostrophes, special tokens and characters of other scripts a text falls
    into runs of letters and of others in the same way, in lower case; runs are parted by blanks and looked up. New runs of letters are
    encoded together, and parted where a token ends a word. Other texts go word by word.
    """

    def __init__(self, file: str | None):
        import public_tokenizers
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file or public_tokenizers.path("word_bpe_49k.json"))
        # for runs of letters, whose normal form they are themselves
        self.plain = Tokenizer.from_str(self.tokenizer.to_str())
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learned(self, new: list[str]) -> list[bytes]:
        """Ids of pieces that are not known: runs of lower-case letters, and others."""
        letters = [w for w in new if _LETTERS.fullmatch(w)]
        found = {}
        if letters:
            ids = np.array(self.plain.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
            ends, data = (np.flatnonzero(self.ends[ids]) + 1).tolist(), ids.tobytes()
            if len(ends) == len(letters):
                found = {w: data[4 * a : 4 * b] for w, a, b in zip(letters, [0, *ends[:-1]], ends, strict=True)}
        found |= {w: self.one(w) for w in new if w not in found}
        if len(self.known) < CACHE_ENTRIES:
            self.known.update((w, i) for w, i in found.items() if len(w) < 40)
        return [found[w] for w in new]

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        gaps = [k for k, x in enumerate(found) if x is None]
        for k, x in zip(gaps, self._learned([pieces[k] for k in gaps]) if gaps else [], strict=True):
            found[k] = x
        return found

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD)
        low = pc.utf8_lower(pc.if_else(odd, "", texts))
        for pattern in _BORDERS:
            low = pc.replace_substring_regex(low, pattern, r"\1 \2")
        words = pc.if_else(odd, texts, low)
        lists = pc.ascii_split_whitespace(words)
        coded, sizes = lists.flatten().dictionary_encode(), lists.value_lengths().to_numpy(zero_copy_only=False)
        at, pieces = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        # words of odd texts are pieces too: those that are no plain run are encoded by themselves
        found = self._of_pieces(pieces)
        lengths = np.array([len(x) // 4 for x in found], "i8")
        data, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(lengths) - lengths
        n = lengths[at]
        ends = np.cumsum(n)
        ids = data[np.repeat(starts[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return ids, np.diff(upto)


_words: dict[str | None, _Words] = {}


def words(file: str | None = None) -> _Words:
    """One cache for each worker process."""
    if file not in _words:
        _words[file] = _Words(file)
    return _words[file]


def write(docs: DataFrame, tokenizer_file: str | None = None, end_id: int = END_ID, path: str | None = None, segment_ids: int = SEGMENT_IDS, slice_rows: int = 1000) -> str:
    """Write the ids of docs(doc_id, text) in ascending order of doc_id; gives the path, by default one in the shared folder.

    Texts are dealt out by ranges of (doc_id, hash of the text, row), so that one doc_id, even of equal rows, fills no task.
    """
    out = f"part long, at long, n_ids long, doc_ids array<{docs.schema['doc_id'].dataType.simpleString()}>, lengths array<long>, codes binary"
    names = ["part", "at", "n_ids", "doc_ids", "lengths", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, at = words(tokenizer_file), TaskContext.get().partitionId(), 0
        doc_ids, ids, lengths, n = [], [], [], 0

        def segment() -> pa.RecordBatch:
            keys, flat = pa.concat_arrays(doc_ids), np.concatenate(ids)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], "i4"), x) for x in (keys, pa.array(np.concatenate(lengths), "i8"))]
            return pa.RecordBatch.from_arrays([*(pa.array([x], "i8") for x in (part, at, len(flat))), *lists, pa.array([encode(flat)], pa.binary())], names)

        for batch in batches:
            for k in range(0, batch.num_rows, slice_rows):
                some = batch.slice(k, slice_rows)
                flat, sizes = known.of(some.column(1))
                flat, sizes = np.insert(flat, np.cumsum(sizes), np.uint32(end_id)), sizes + 1
                # a segment is closed with the document that fills it
                upto, first = np.cumsum(sizes), 0
                while first < len(sizes):
                    before = int(upto[first] - sizes[first])
                    last = min(int(np.searchsorted(upto, before + segment_ids - n)) + 1, len(sizes))
                    doc_ids.append(some.column(0).slice(first, last - first))
                    ids.append(flat[before : upto[last - 1]])
                    lengths.append(sizes[first:last])
                    n, first = n + int(upto[last - 1]) - before, last
                    if n >= segment_ids:
                        yield segment()
                        doc_ids, ids, lengths, at, n = [], [], [], at + n, 0
        if doc_ids:
            yield segment()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    path = path or f"{shared_dir(docs.sparkSession)}/codes-{uuid.uuid4().hex}"
    placed.mapInArrow(run, out).write.option("compression", "none").parquet(path)
    return path


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a path, each with `start`, its first id in the whole stream."""
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("total"))
    # one row for each task that wrote
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return files.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("at"))


def documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) read back from the files: ids are little-endian and unsigned, 32 bits each;
    with_ids=False leaves them in the tasks."""
    found = segments(spark, path).select("doc_ids", "lengths", "start", "codes")
    kind = found.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, lengths = Segment(batch.column(3)[k].as_py(), check=True).ids(), np.array(batch.column(1)[k].as_py(), "i8")
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                parts = [memoryview(data)[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [batch.column(0)[k].values, pa.array(batch.column(2)[k].as_py() + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([bytes(p) for p in parts], pa.binary())] if with_ids else []), ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return found.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def tokens_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """(position, id) of places in the stream, by their codes; only segments that hold one are read. A place that is
    none gives no row."""
    asked = F.array(*[F.lit(int(p)) for p in sorted(set(positions))])
    inside = F.filter(asked, lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n_ids")))
    held = segments(spark, path).select("part", "at").where(F.size(inside) > 0) if positions else None
    keys = [(r["part"], r["at"]) for r in held.collect()] if positions else []  # at most one for each position
    found = segments(spark, path).filter(F.col("part").isin([p for p, _ in keys]) & F.col("at").isin([a for _, a in keys])).filter(F.size(inside) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                segment, start, places = Segment(batch.column(0)[k].as_py()), batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(places, "i8"), pa.array([segment[p - start] for p in places], "i8")], ["position", "id"])

    return found.select("codes", "start", inside.cast("array<long>").alias("places")).mapInArrow(run, "position long, id long")


def op12_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, write(spark.read.parquet(f"{sf_dir}/documents.parquet")), with_ids=False)
