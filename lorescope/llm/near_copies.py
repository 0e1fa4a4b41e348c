"""The pipeline's near-duplicate stage: five-word shingle sets with a Jaccard similarity of 0.8 or more.

Candidates come from SimHash prints of the sets, linked by pigeonring chains (simhash.links), and from MinHash
bands, as prints at a distance that pairs of 0.8 need (mostly 5 to 15 of 64 bits) would have to be compared all with
all. The sets themselves decide about every candidate. Equal sets are one node.

What meets in a band key is tested in two steps. First every node is tested against one hub of the key, the node that
meets most others over all its bands. Of what is then still in different components, each node outside of the key's
largest component is tested against all nodes of the key. Tests run within tasks, by blocks of bounded size, and give
forests, never pairs; no two nodes of different components that meet in a key are left untested.

With 24 bands of five hashes a pair of similarity 0.8 never meets with probability (1 - 0.8^5)^24 = 7e-5,
one of 0.85 with 8e-7. Shingles are compared by 32 bits of their hash.

Defined results. Words are split and lowered as in simhash. A text of one to four words is one shingle; null
and blank texts have none and are alike. Components close links over. Of each component one row stays: the one with
the smallest doc_id, null last; of rows equal in it, any one. Very long texts are hashed whole, in chunks. Only doc_id
and text are read; all columns pass through.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from . import simhash
from .common import settled, shared_dir, small_or_not, with_totals

SHINGLE = 5
BANDS, ROWS = 24, 5
BLOCK = 128
#: A set counts once more in its block for each so many shingles; values that are counted at once.
LONG_SET, AT_ONCE = 20_000, 2_000_000
#: Bits of a row's number within its bitmap; bitmaps (of 64 words at most) that are broadcast together.
MAP_BITS, MAPS = 12, 1 << 16
_SEEDS = np.random.default_rng(8).integers(0, 2**64, (2, BANDS * ROWS), "u8")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 4096


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The different shingles' XXH64 hashes (seed 42) in order."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.array([], "u8")
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= k:
        return np.array([xxh64_intdigest(line, 42)], "u8")
    starts = [0, *(e + 1 for e in ends[: -k])]
    return np.unique(np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[k - 1 :], strict=True)], "u8"))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of its least values under five of the orders."""
    if not len(hashes):
        return np.array([], "u8")
    least = np.full(BANDS * ROWS, 2**64 - 1, "u8")
    for at in range(0, len(hashes), _CHUNK):
        x = (hashes[None, at : at + _CHUNK] ^ _SEEDS[0][:, None]) * (_SEEDS[1] | np.uint64(1))[:, None]
        least = np.minimum(least, x.min(axis=1))
    keys = np.arange(BANDS, dtype="u8")
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def sketched(docs: DataFrame, slice_rows: int = 256) -> DataFrame:
    """Write each row with its sketches to the shared folder and read it again: rid (a number of its own), row, fp (a
    hash of the whole set), print (its SimHash), n, keys of the bands, and shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        at = TaskContext.get().partitionId() << 40
        for whole in batches:
            for k in range(0, whole.num_rows, slice_rows):
                rows = whole.slice(k, slice_rows).column(0)
                sets = [shingles(t) for t in pc.struct_field(rows, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(at, at + len(rows))),
                        rows,
                        pa.array(np.array([xxh64_intdigest(s.tobytes(), 42) for s in sets], "u8").view("i8")),
                        pa.array(np.array([simhash.majority(s) for s in sets], "u8").view("i8")),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([band_keys(s).view("i8") for s in sets], pa.list_(pa.int64())),
                        pa.array([s.astype("u4").view("i4") for s in sets], pa.list_(pa.int32())),
                    ],
                    names,
                )
                at += len(rows)

    kind = T.StructType.fromDDL("rid long, fp long, print long, n long, keys array<long>, shingles array<int>")
    kind = T.StructType([kind[0], T.StructField("row", docs.schema), *kind[1:]])
    names = kind.names
    path = f"{shared_dir(docs.sparkSession)}/shingles-{uuid.uuid4().hex}"
    docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).mapInArrow(run, kind).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _flat(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the row of each."""
    sizes = pc.list_value_length(sets).to_numpy(zero_copy_only=False)
    return pc.list_flatten(sets).to_numpy(), np.repeat(np.arange(len(sizes), dtype="i4"), sizes)


def _shared(sides: list[tuple[np.ndarray, np.ndarray]], same: np.ndarray) -> None:
    """Add to same[i, j] the number of values that row i of one side and row j of the other have in common."""
    both = np.intersect1d(sides[0][0], sides[1][0])
    found = []
    for values, rows in sides:
        at = np.searchsorted(both, values)
        hit = at < len(both)
        hit[hit] = both[at[hit]] == values[hit]
        order = np.argsort(at[hit], kind="stable")
        found.append((at[hit][order], rows[hit][order]))
    for low in range(0, len(both), _CHUNK):
        width, parts = min(_CHUNK, len(both) - low), []
        for (at, rows), n in zip(found, same.shape, strict=True):
            x, y = np.searchsorted(at, [low, low + width])
            m = np.zeros((n, width), "f4")
            m[rows[x:y], at[x:y] - low] = 1
            parts.append(m)
        same += parts[0] @ parts[1].T


def similar(own: pa.Array, asking: pa.Array, at_once: int = AT_ONCE) -> np.ndarray:
    """Which sets of `own` have a similarity of 0.8 or more with which of `asking`. Values are counted range by range, about `at_once`
    in each, so that beside the sets themselves memory does not grow with their sizes."""
    sides = [_flat(own), _flat(asking)]
    same = np.zeros((len(own), len(asking)), "f4")
    edges = np.linspace(-(2**31), 2**31, max(1, -(-sum(len(v) for v, _ in sides) // at_once)) + 1).astype("i8")
    for low, high in zip(edges, edges[1:], strict=False):
        _shared([(v[inside], r[inside]) for v, r in sides for inside in [(v >= low) & (v < high)]] if len(edges) > 2 else sides, same)
    sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (own, asking)]
    return 9 * same >= 4 * (sizes[0][:, None] + sizes[1][None, :])


def tested(keys: DataFrame, sets: DataFrame, block: int = BLOCK, long: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) of forests of the links between nodes of one key: role 0 with role 1, if their `top` differs.

    keys: fp, start, key, role, top; sets: fp, shingles. long(fp, weight) names the long sets, if there are any: they weigh more in their blocks, so
    that a unit is bounded by its shingles.
    """
    unit = ["start", "key", "i", "j"]

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, last = [], None
        for batch in batches:
            ids = np.column_stack([batch.column(c).to_numpy() for c in unit])
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)] if len(ids) else [0]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if held and tuple(ids[x]) != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(x, y - x))
                last = tuple(ids[x])
        if held:
            yield pa.Table.from_batches(held)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()

        def out() -> pa.RecordBatch:
            pairs = np.array(sorted(found), "i8").reshape(-1, 2)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for part in units(batches):
            role = part.column("role").to_numpy()
            if role.min() == role.max():
                continue
            sides = [part.filter(pa.array(role == r)).combine_chunks() for r in (0, 1)]
            tops = [s.column("top").to_numpy() for s in sides]
            apart = tops[0][:, None] != tops[1][None, :]
            if apart.any():
                near = similar(*(s.column("shingles").combine_chunks() for s in sides)) & apart
                if near.any():
                    fps = [s.column("fp").to_numpy().view("u8") for s in sides]
                    found.update(zip(*(x.view("i8").tolist() for x in simhash.forest(*fps, near)), strict=True))
            if len(found) > 100_000:
                yield out()
        yield out()

    if long is not None:
        keys = keys.join(small_or_not(long), "fp", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
    rows = simhash.dealt(keys, block).join(sets, "fp").select(*unit, "role", "fp", "top", "shingles")
    return rows.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(solve, "a long, b long").distinct()


def _asked(pairs: DataFrame) -> DataFrame:
    """Keys for tested() from pairs (a, b): each a is asked by its b's."""
    pairs = pairs.filter("a <> b").distinct()
    zero = F.lit(0).alias("start")
    own = pairs.select(F.col("a").alias("fp"), zero, F.col("a").alias("key"), F.lit(0).alias("role"), F.col("a").alias("top")).distinct()
    return own.union(pairs.select(F.col("b").alias("fp"), zero, F.col("a").alias("key"), F.lit(1).alias("role"), F.col("b").alias("top")))


def by_print(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b) from nodes(fp, print): sets of one print, and the first sets of prints that are linked."""
    prints = settled(nodes.groupBy("print").agg(F.min("fp").alias("first"), F.count("*").alias("n")))
    edges = simhash.links(prints.select(F.col("print").alias("fp")), long_keys=prints.count() >= simhash.LONG_KEYS_FROM)
    one, two = (prints.select(F.col("print").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    linked = edges.join(one, "a").join(two, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    same = with_totals(nodes.select("fp", "print"), prints.filter("n > 1"), "print", prints.count())
    return linked.union(same.select(F.col("first").alias("a"), F.col("fp").alias("b"))).filter("a <> b")


def with_top(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """rows with the top of their fp's component."""
    return rows.join(tops.select(F.col("node").alias("fp"), F.col("top").alias("__top")), "fp", "left").withColumn("top", F.coalesce("__top", "fp")).drop("__top")


def joined_by(tops: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, top) with more edges between them. They go in as stars, so that few rounds are left."""
    return simhash.components(tops.select(F.col("node").alias("a"), F.col("top").alias("b")).union(edges))


def components(nodes: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, top) of all nodes that are linked to another. nodes: fp, rid of one of its rows, print and keys."""
    keys = nodes.select("fp", F.explode("keys").alias("key"))
    met = keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key")
    met = settled(met)
    pairs = settled(by_print(nodes))
    wanted = met.select("fp").union(pairs.select("a")).union(pairs.select("b")).distinct().join(nodes.select("fp", "rid"), "fp").select("rid")
    sets = settled(sketches.select("rid", "fp", "shingles").join(small_or_not(settled(wanted)), "rid", "left_semi").drop("rid"))
    long = settled(sketches.filter(F.col("n") >= LONG_SET).select("fp", (1 + F.floor(F.col("n") / LONG_SET)).cast("int").alias("weight")).distinct().coalesce(1))
    long = long if long.take(1) else None
    tops = simhash.components(tested(_asked(pairs), sets, long=long))

    hubs = with_top(met, tops).join(met.groupBy("fp").agg(F.sum("n").alias("met")), "fp")
    hubs = settled(hubs.groupBy("key").agg(F.max_by(F.struct(F.col("fp").alias("hub"), F.col("top").alias("hub_top")), F.struct("met", "fp")).alias("hub"), F.count_distinct("top").alias("tops"), F.count("*").alias("n")))
    around = with_totals(with_top(met.drop("n"), tops), hubs.filter("tops > 1"), "key")
    pairs = settled(around.filter("top <> hub.hub_top").select(F.col("hub.hub").alias("a"), F.col("fp").alias("b")).distinct())
    tops = joined_by(tops, tested(_asked(pairs), sets, long=long))

    left = settled(with_top(met.drop("n"), tops))
    sizes = left.groupBy("key", "top").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("top", F.struct("k", "top")).alias("largest"), F.count("*").alias("tops"), F.sum("k").alias("n"))
    mixed = with_totals(left, settled(sizes.filter("tops > 1").drop("tops")), "key")
    own = mixed.select("fp", F.lit(0).alias("start"), "key", F.lit(0).alias("role"), "top")
    asking = mixed.filter("top <> largest").select("fp", F.lit(0).alias("start"), "key", F.lit(1).alias("role"), "top")
    return joined_by(tops, tested(settled(own.union(asking)), sets, long=long))


def slices(counts: list[tuple[int, int]], most: int) -> list[int]:
    """Where ranges begin, besides the first, so that each has `most` at most. counts: (key, number) in order of key."""
    starts, held = [], 0
    for key, n in counts:
        if held and held + n > most:
            starts.append(key)
            held = 0
        held += n
    return starts


def without(sketches: DataFrame, gone: DataFrame, most: int = MAPS) -> DataFrame:
    """The rows whose rid isn't in gone; they stay where they lie, whatever the number that goes.

    What goes is a bit for each rid. Its bitmaps meet the rows by broadcast, in ranges of rid with `most` bitmaps (some
    64 MB) each; files have their rids in order, so a range reads its own files and row groups.
    """
    words = gone.groupBy(F.shiftright("rid", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("rid").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    # at most 64 words each
    maps = words.groupBy(F.shiftright("word", MAP_BITS - 6).alias("map")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(F.lit(63)), "bits"))).alias("words"))
    maps = settled(maps)
    # a range counted at once has no more bitmaps than a slice may have
    width = most.bit_length() - 1
    counts = maps.groupBy(F.shiftright("map", width).alias("range")).count().orderBy("range").collect()  # two numbers for 2^28 rows or a task
    starts = [s << (width + MAP_BITS) for s in slices([tuple(r) for r in counts], most)]
    out = None
    for a, b in zip([None, *starts], [*starts, None], strict=True):
        mine, marks = sketches.select("rid", "row"), maps
        if a is not None:
            mine, marks = mine.filter(F.col("rid") >= a), marks.filter(F.col("map") >= a >> MAP_BITS)
        if b is not None:
            mine, marks = mine.filter(F.col("rid") < b), marks.filter(F.col("map") < b >> MAP_BITS)
        met = mine.join(F.broadcast(marks), F.shiftright("rid", MAP_BITS) == F.col("map"), "left")
        bits = F.coalesce(F.try_element_at("words", F.shiftright("rid", 6).bitwiseAND(F.lit(63))), F.lit(0).cast("long"))
        met = met.filter(F.getbit(bits, F.col("rid").bitwiseAND(F.lit(63)).cast("int")) == 0).select("row.*")
        out = met if out is None else out.unionAll(met)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies, with the columns of docs."""
    sketches = sketched(docs)
    best = F.min(F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), "rid")).alias("best")
    nodes = sketches.groupBy("fp").agg(best, F.min("rid").alias("rid"), F.any_value("print").alias("print"), F.any_value("keys").alias("keys"))
    nodes = settled(nodes)
    tied = with_top(nodes.select("fp", "best"), components(nodes, sketches))
    stay = settled(tied.groupBy("top").agg(F.min("best").alias("best")).select("best.rid"))
    gone = settled(sketches.select("rid").join(stay, "rid", "left_anti"))
    return without(sketches, gone)
