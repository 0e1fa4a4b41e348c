"""SimHash near-duplicates: fingerprints, pigeonring candidates, exact Hamming links, components.

Fingerprints of 64 bits lie on a ring of m segments. If two differ in at most t bits, some segment
starts a chain such that for every length l the first l segments differ in at most l*t/m bits
together (the strong form of the pigeonring principle). With m = t + 1 the first segment agrees and the
first two differ in at most one bit: this is the key under which fingerprints meet. Then the
longer chains are tested one by one, and only what passes all of them gets the full Hamming test.

Equal fingerprints are one node. A key's fingerprints are dealt into blocks of bounded size and every
pair of blocks is a unit of work, so that a key with a third of all nodes is many small units. A unit
emits a forest of the links it finds (each node and the smallest it is tied to), never all pairs.

Defined results. A null or blank text has fingerprint 0 and is linked like any other. Rows with one
doc_id are one document. An empty table gives an empty result. A very long text is hashed in chunks of
shingles. Only doc_id and text are read.

A key or a component that holds a third of all rows is never one task: what is joined by a hot key meets a broadcast
of at most 10,000 totals (common.with_totals).
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from .common import settled, small_or_not, with_totals

BITS = 4
SHINGLE = 4
BLOCK = 512
#: From this number of different fingerprints on, keys have two segments with up to one bit changed;
#: below it one segment is selective enough. The links found are the same.
LONG_KEYS_FROM = 1 << 21
_CHUNK = 1 << 16
#: Edges of a checkpoint's file.
ROWS_A_FILE = 50_000


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42), repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= k:
        return xxh64_intdigest(b" ".join(words), 42)
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    stops, line = ends[k - 1 :].tolist(), b" ".join(words)
    return majority(np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)), "<u8", len(starts)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, "int64")
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], "u8").view("i8"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long)."""
    return docs.select("doc_id", _fingerprints(F.coalesce("text", F.lit(""))).alias("fp"))


def segments(bits: int = BITS) -> list[tuple[int, int]]:
    """(shift, width) of bits + 1 segments of nearly equal width."""
    m = bits + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _piece(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def keyed(nodes: DataFrame, bits: int = BITS, long_keys: bool = False) -> DataFrame:
    """fp, start, key and role (0: stands under its own key, 1: asks under this key).

    Short keys are the chain's first segment. Long keys are its first two; an asking fingerprint is
    put under its own and under every one with a bit of the second segment changed.
    """
    segs, asks = segments(bits), []
    for i, (shift, width) in enumerate(segs):
        key = _piece(F.col("fp"), shift, width)
        flips: list = [0]
        if long_keys:
            next_shift, next_width = segs[(i + 1) % len(segs)]
            key = F.shiftleft(key, next_width).bitwiseOR(_piece(F.col("fp"), next_shift, next_width))
            flips += [1 << b for b in range(next_width)]
        asks.append(F.struct(F.lit(i).alias("start"), key.alias("key"), F.lit(0).alias("role")))
        asks += [F.struct(F.lit(i).alias("start"), key.bitwiseXOR(F.lit(f).cast("long")).alias("key"), F.lit(1).alias("role")) for f in flips]
    return nodes.select("fp", F.explode(F.array(*asks)).alias("a")).select("fp", "a.*")


def dealt(keys: DataFrame, block: int = BLOCK) -> DataFrame:
    """Deal each key's fingerprints into blocks; a row goes to each pair of blocks that has its own.

    keys has fp, start, key, role and any other columns, which go along; with a `weight` a row counts as so many.
    """
    weight = F.col("weight") if "weight" in keys.columns else F.lit(1)
    sizes = keys.groupBy("start", "key").agg(F.sum((1 - F.col("role")) * weight).alias("own"), F.sum(F.col("role") * weight).alias("asking"))
    sizes = settled(sizes.filter((F.col("own") > block) | (F.col("asking") > block)))
    sizes = sizes.select("start", "key", F.ceil(F.col("own") / block).alias("a"), F.ceil(F.col("asking") / block).alias("b"))
    one = F.lit(1).cast("long")
    # only keys with more than a block are in sizes: the others' rows find nothing and are one unit
    rows = keys.join(small_or_not(sizes), ["start", "key"], "left").withColumns({"a": F.greatest(F.coalesce("a", one), one), "b": F.greatest(F.coalesce("b", one), one)})
    mine = F.pmod(F.xxhash64("fp"), F.when(F.col("role") == 0, F.col("a")).otherwise(F.col("b")))
    others = F.sequence(one * 0, F.when(F.col("role") == 0, F.col("b")).otherwise(F.col("a")) - 1)
    rows = rows.select(*keys.columns, mine.alias("mine"), F.explode(others).alias("other"))
    unit = [F.when(F.col("role") == 0, F.col("mine")).otherwise(F.col("other")).alias("i"), F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("mine")).alias("j")]
    return rows.select(*keys.columns, *unit)


def ring_masks(start: int, bits: int) -> list[tuple[np.uint64, int]]:
    """For each chain from `start`: its bits, and how many of them may differ."""
    segs, masks, seen = segments(bits), [], 0
    for n in range(1, len(segs) + 1):
        shift, width = segs[(start + n - 1) % len(segs)]
        seen |= ((1 << width) - 1) << shift
        masks.append((np.uint64(seen), n * bits // len(segs)))
    return masks


def _near(own: np.ndarray, asking: np.ndarray, masks) -> np.ndarray:
    """Which pairs are links. Each longer chain is only tested for the pairs that passed the shorter."""
    x = (own[:, None] ^ asking[None, :]).ravel()
    left = np.arange(x.size)
    for mask, budget in masks:
        left = left[np.bitwise_count(x[left] & mask) <= budget]
    out = np.zeros(x.size, bool)
    out[left] = True
    return out.reshape(len(own), len(asking))


def forest(own: np.ndarray, asking: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the linked pairs with the smallest node that it is tied to within this unit."""
    rows, cols = near.any(axis=1), near.any(axis=0)
    own, asking, near = own[rows], asking[cols], near[np.ix_(rows, cols)]
    top = np.uint64(2**64 - 1)
    a, b = own.copy(), asking.copy()
    while True:
        a2 = np.minimum(a, np.where(near, b[None, :], top).min(axis=1))
        b2 = np.minimum(b, np.where(near, a2[:, None], top).min(axis=0))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    nodes, tops = np.concatenate([own, asking]), np.concatenate([a, b])
    tied = nodes != tops
    return nodes[tied], tops[tied]


def links(nodes: DataFrame, bits: int = BITS, long_keys: bool = False, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all links between nodes(fp)."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks, held = [ring_masks(i, bits) for i in range(bits + 1)], None
        found = set()

        def unit(part: pd.DataFrame) -> None:
            fp, role = part.fp.to_numpy().view("u8"), part.role.to_numpy()
            own, asking = fp[role == 0], fp[role == 1]
            if len(own) and len(asking):
                near = _near(own, asking, masks[part.start.iat[0]]) & (own[:, None] != asking[None, :])
                if near.any():
                    found.update(zip(*(x.view("i8").tolist() for x in forest(own, asking, near)), strict=True))

        def out() -> pd.DataFrame:
            pairs = np.array(sorted(found), "i8").reshape(-1, 2)
            found.clear()
            return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            change = np.flatnonzero((batch[["start", "key", "i", "j"]].to_numpy()[1:] != batch[["start", "key", "i", "j"]].to_numpy()[:-1]).any(axis=1)) + 1
            edges = [0, *change.tolist()]
            for x, y in zip(edges, edges[1:], strict=False):
                unit(batch.iloc[x:y])
            held = batch.iloc[edges[-1] :]  # it may go on in the next batch
            if len(found) > 100_000:
                yield out()
        if held is not None and len(held):
            unit(held)
        yield out()

    rows = dealt(keyed(nodes, bits, long_keys), block).repartition("start", "key", "i", "j").sortWithinPartitions("start", "key", "i", "j")
    return rows.mapInPandas(solve, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, top): each node of the edges with the smallest node of its component.

    Alternates large-star and small-star steps until neither changes an edge; each result is settled.
    """
    edges = settled(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = total(edges)
    # few edges need few files: 50,000 in each
    parts = 1 + before[0] // ROWS_A_FILE
    edges = edges.coalesce(parts)
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        tops = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("top"), F.count("*").alias("n"))
        large = with_totals(both, tops, "a", 2 * before[0]).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("top").alias("b"))
        large = settled(large.filter("a <> b").distinct().coalesce(parts))
        tops = large.groupBy("a").agg(F.min("b").alias("top"), F.count("*").alias("n"))
        small = with_totals(large, tops, "a", 2 * before[0])
        small = small.select(F.col("b").alias("a"), F.col("top").alias("b")).union(tops.select("a", F.col("top").alias("b")))
        edges = settled(small.filter("a <> b").distinct().coalesce(parts))
        after = total(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("top"))
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, bits: int = BITS, block: int = BLOCK, long_keys: bool | None = None) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach."""
    prints = settled(fingerprints(docs))
    nodes = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    if long_keys is None:
        long_keys = nodes.count() >= LONG_KEYS_FROM
    return named(prints, nodes, components(links(nodes.select("fp"), bits, long_keys, block)))


def named(prints: DataFrame, nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """prints(doc_id, fp) with component_id, from nodes(fp, first, n) and the components' (node, top)."""
    tied = settled(nodes.join(tops, nodes.fp == tops.node, "left").select("fp", "first", "n", F.coalesce("top", "fp").alias("top")))
    names = settled(tied.groupBy("top").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    ids = settled(with_totals(tied.withColumnRenamed("n", "rows"), names, "top").select("fp", "component_id", F.col("rows").alias("n")))
    return with_totals(prints, ids, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
