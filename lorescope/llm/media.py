"""Media columns: binary payloads stored as PNG images, read back, and given perceptual hashes.

A payload is laid out as rows of 64 RGB pixels and written as PNG: signature, chunks with checksums, row
filters, zlib. Reading tests every checksum, inflates and undoes the filters with numpy. The image's
hash holds the signs, around their median, of the 8 x 8 lowest frequencies of its cosine transform.

Defined results. A null text is empty; an empty payload is one row of blanks. Equal texts give equal bytes. A very
long text is one tall image in chunks of CHUNK bytes; a task holds one batch of images at a time.
Repeated rows are coded alike, an empty table gives no row, and only doc_id and text are read. A
damaged image raises ValueError in decode() and gives nulls in decoded().
"""

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, SAMPLES = 64, 3
ROW = WIDTH * SAMPLES
CHUNK = 1 << 20
LEVEL = 3
SIDE, LOW = 32, 8


def padded(text: str) -> tuple[bytes, int]:
    """The text's UTF-8 with blanks up to a positive multiple of a row, and its length without them."""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(ROW, -(-len(raw) // ROW) * ROW)
    return raw.ljust(size, b" "), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode(payload: bytes) -> bytes:
    """PNG of 8-bit RGB samples; each row takes the filter (none, left, up) with the smallest sum of differences."""
    rows = np.frombuffer(payload, "u1").reshape(-1, ROW)
    left, up = rows.copy(), rows.copy()
    left[:, SAMPLES:] -= rows[:, :-SAMPLES]
    up[1:] -= rows[:-1]
    cost = [np.abs(x.view("i1").astype("i2")).sum(axis=1) for x in (rows, left, up)]
    best = np.argmin(cost, axis=0)
    lines = np.empty((len(rows), ROW + 1), "u1")
    lines[:, 0] = best
    lines[:, 1:] = np.where(best[:, None] == 0, rows, np.where(best[:, None] == 1, left, up))
    body = zlib.compress(lines.tobytes(), LEVEL)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", body[k : k + CHUNK]) for k in range(0, len(body), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + data + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("a chunk is cut short")
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        if len(body) != n or png[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"checksum of {kind!r} is wrong")
        yield kind, body
        at += 12 + n


def _undo(filters: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Undo the five row filters. Runs of rows that need no row above, or only add it, go at once."""
    out, at = np.empty_like(lines), 0
    edges = np.flatnonzero(np.diff(filters)) + 1
    for end in [*edges.tolist(), len(lines)]:
        kind, part = filters[at], lines[at:end]
        if kind == 0:
            out[at:end] = part
        elif kind == 1:
            out[at:end] = np.cumsum(part.reshape(len(part), -1, step), axis=1, dtype="u1").reshape(part.shape)
        elif kind == 2:
            above = out[at - 1] if at else np.zeros(lines.shape[1], "u1")
            out[at:end] = np.cumsum(part, axis=0, dtype="u1") + above
        elif kind in (3, 4):
            for y in range(at, end):
                above = out[y - 1] if y else np.zeros(lines.shape[1], "u1")
                _undo_row(int(kind), lines[y], above, out[y], step)
        else:
            raise ValueError(f"row filter {kind} is unknown")
        at = end
    return out


def _undo_row(kind: int, line: np.ndarray, above: np.ndarray, out: np.ndarray, step: int) -> None:
    for x in range(len(line)):
        a = int(out[x - step]) if x >= step else 0
        b, c = int(above[x]), int(above[x - step]) if x >= step else 0
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[x] = (int(line[x]) + guess) & 255


def decode(png: bytes) -> np.ndarray:
    """Height x width x samples of an 8-bit grey, RGB or RGBA image without interlacing."""
    found = list(chunks(png))
    if not found or found[0][0] != b"IHDR" or found[-1][0] != b"IEND":
        raise ValueError("first or last chunk is missing")
    width, height, depth, colour, packed, filtered, laced = struct.unpack(">IIBBBBB", found[0][1])
    samples = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or samples is None or packed or filtered or laced:
        raise ValueError("this kind of PNG is not read")
    data = [k for k, (kind, _) in enumerate(found) if kind == b"IDAT"]
    if not data or data[-1] - data[0] != len(data) - 1:
        raise ValueError("data chunks are missing or don't follow each other")
    flat = zlib.decompress(b"".join(found[k][1] for k in data))
    if len(flat) != height * (width * samples + 1):
        raise ValueError("the image's size is wrong")
    lines = np.frombuffer(flat, "u1").reshape(height, -1)
    return _undo(lines[:, 0], lines[:, 1:], samples).reshape(height, width, samples)


_WAVES = np.cos(np.pi * (np.arange(SIDE) + 0.5)[None, :] * np.arange(LOW)[:, None] / SIDE)


def image_hash(image: np.ndarray) -> bytes:
    """8 bytes: which of the 64 low frequencies lie over their median (that of the mean is left out)."""
    for axis in (0, 1):
        n = image.shape[axis]
        edges = np.arange(SIDE) * n // SIDE
        if n >= SIDE:
            image = np.add.reduceat(image, edges, axis=axis, dtype="int64" if axis == 0 else None) / np.diff([*edges, n]).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
        else:
            image = image.take(edges, axis=axis)
    low = np.round(_WAVES @ image.mean(axis=2) @ _WAVES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the PNG of each text."""

    @F.pandas_udf("n_bytes long, png binary")
    def image(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            made = [padded(t) for t in batch]
            yield pd.DataFrame({"n_bytes": pd.Series([n for _, n in made], dtype="int64"), "png": [encode(p) for p, _ in made]})

    return docs.select("doc_id", image(F.coalesce("text", F.lit(""))).alias("i")).select("doc_id", "i.*")


def decoded(images: DataFrame) -> DataFrame:
    """What reading the png column back gives: sizes, digests, and the hash as a binary column."""

    kind = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, image_hash binary"

    @F.pandas_udf(kind)
    def read(pngs: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in pngs:
            rows = []
            for png in batch:
                try:
                    image = decode(png)
                except (TypeError, ValueError, zlib.error, struct.error):
                    rows.append((None,) * 6)
                    continue
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), image_hash(image)))
            out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "image_hash"])
            yield out.astype({c: "Int64" for c in ("payload_bytes", "tail_crc32", "media_bytes")})

    return images.select("doc_id", "n_bytes", read("png").alias("r")).select("doc_id", "n_bytes", "r.*")


def op9_media(spark, sf_dir: str) -> DataFrame:
    out = decoded(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.withColumn("feature", F.lower(F.hex("image_hash"))).drop("image_hash")
