"""Hard negatives by a vertical scan of embeddings (BOND).

Entries become whole numbers, floor(256 * c); a score is an inner product. Rows are stored in blocks, dimension after dimension.
An anchor reads a block's dimensions in the order of its own entries' sizes, the largest first. What a row has so far and the
least and most that the remaining dimensions can add (from each one's range in the block) bound its score; rows that can no longer
matter leave the bitmap of candidates, and the few that stay get exact scores.

Two scans: the first finds each anchor's positives, the best of its own label; the second, for each positive with score p,
the best of other labels with score from floor_share * p to p (in hundredths, compared as whole numbers), its window. Anchors and blocks are dealt into
units: a task holds one block of anchors and reads blocks of rows one after another, carrying each anchor's best so far, and gives
`limit` rows for each anchor (or window), which are then merged. No label or copied vector comes together in a task, and
pairs never leave it.

Defined results. Rows with a null id, label or vector, null or non-finite entries, an entry beyond +-2^18, or another length than
most rows have (of equally many, the longest) take no part. Rows that share an anchor's id are no others of it; repeated rows count
one by one as positives and negatives and ask once as anchors, while one id with several labels or vectors asks with each. Ties go by
id. A positive without a row in its window, such as one of negative score, gives no row. An empty table gives none. Only id, label and vector are read.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import settled, shared_dir

SCALE = 256
#: With entries up to this, sums of products stay within a long for up to 2,048 dimensions.
MOST = 2**26
#: Rows of a block, anchors of a block, and groups at most into which blocks of rows are dealt for each block of anchors.
ROWS, ANCHORS, GROUPS = 2048, 8192, 256
#: Dimensions read between two looks at the bounds.
STEP = 8
LIMIT = 5
#: A window goes from so many hundredths of its positive's score to the score.
LOW = 80

BLOCK = "block long, n int, ids binary, labels binary, width int, columns binary, lows binary, highs binary"


def _dimension(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have."""
    counts = rows.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), F.desc("dim")).first()
    return first["dim"] if first else 0


def _usable(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and whole vectors of the rows of a batch (id, label, vector) that take part."""
    ids, labels, vectors = batch.columns
    fits = pc.and_(pc.and_(ids.is_valid(), labels.is_valid()), pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False))
    ids, labels, vectors = (c.filter(fits) for c in (ids, labels, vectors))
    m = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim))
    good = (np.abs(np.where(np.isfinite(m), m, np.inf)) <= MOST).all(axis=1)
    return ids.to_numpy().astype("i8")[good], labels.to_numpy().astype("i8")[good], m[good].astype("i8")


def blocks(rows: DataFrame, dim: int, block_rows: int = ROWS) -> DataFrame:
    """rows(id, label, vector) as vertical blocks of a partition's rows, written to the shared folder and read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, ...]] = []

        def block(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            nonlocal number
            ids, labels, x = (np.concatenate(p) for p in zip(*parts, strict=True))
            width = 2 if np.abs(x).max() < 2**15 else 4
            row = (number, len(ids), ids.tobytes(), labels.tobytes(), width, x.T.astype(f"<i{width}").tobytes(), x.min(axis=0).tobytes(), x.max(axis=0).tobytes())
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

        for whole in batches:
            for k in range(0, whole.num_rows, block_rows):
                part = _usable(whole.slice(k, block_rows), dim)
                while len(part[0]):
                    room = block_rows - sum(len(p[0]) for p in held)
                    held.append(tuple(c[:room] for c in part))
                    part = tuple(c[room:] for c in part)
                    if sum(len(p[0]) for p in held) == block_rows:
                        yield block(held)
                        held = []
        if held:
            yield block(held)

    path = f"{shared_dir(rows.sparkSession)}/blocks-{uuid.uuid4().hex}"
    rows.mapInArrow(run, BLOCK).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def anchors_of(rows: DataFrame, dim: int, chosen: Column) -> DataFrame:
    """(anchor, id, label, x): the chosen rows that take part, each once; x are whole numbers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, x = _usable(batch, dim)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())], ["id", "label", "x"])

    found = rows.filter(chosen).mapInArrow(run, "id long, label long, x binary").distinct()
    # an anchor's name: its id, and a hash for ids with several labels or vectors
    return found.select(F.struct("id", F.xxhash64("label", "x").alias("tie")).alias("anchor"), "id", "label", "x")


class _Scan:
    """A block of anchors, and for each of its windows the best rows so far."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, same: bool, windows: list[np.ndarray], limit: int):
        self.ids, self.labels, self.x, self.same, self.windows, self.limit = ids, labels, x, same, windows, limit
        self.order = np.argsort(-np.abs(x), axis=1, kind="stable")
        self.best = [[(np.empty(0, "i8"), np.empty(0, "i8"))] * len(w) for w in windows]  # ids, scores
        self.looked = self.read = 0

    def block(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> None:
        """columns: dimension by row."""
        self.read += columns.size * len(self.ids)
        # the most and the least that each dimension can give, for all anchors
        edges = self.x * lows, self.x * highs
        least, most = np.minimum(*edges), np.maximum(*edges)
        exact = float(np.abs(self.x).max(initial=0)) * float(max(np.abs(lows).max(), np.abs(highs).max())) * len(columns) < 2**53
        columns = columns.astype("f8" if exact else "i8")
        for k in range(len(self.ids)):
            if len(self.windows[k]):
                self._anchor(k, ids, labels, columns, least[k], most[k])

    def _anchor(self, k: int, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
        order, x = self.order[k], self.x[k].astype(columns.dtype)
        # what is left to add after m dimensions, at least and at most
        rest = [np.append(np.cumsum(e[order][::-1])[::-1], 0) for e in (least, most)]
        windows = self.windows[k]
        # a full list shuts a window from below: what ends under its last row can't enter
        floors = np.array([max(w[0], s[-1]) if len(s) == self.limit else w[0] for w, (_, s) in zip(windows, self.best[k], strict=True)])
        ceilings = windows[:, 1]
        alive = np.flatnonzero(((labels == self.labels[k]) == self.same) & (ids != self.ids[k]))
        score = np.zeros(len(alive), columns.dtype)
        for m in range(0, len(order), STEP):
            if not len(alive):
                return
            dims = order[m : m + STEP]
            self.looked += len(dims) * len(alive)
            part = columns[dims]
            score = score + x[dims] @ (part if len(alive) == part.shape[1] else part[:, alive])
            after = min(m + STEP, len(order))
            low, high = score + rest[0][after], score + rest[1][after]
            keep = np.zeros(len(alive), bool)
            for floor, ceiling in zip(floors, ceilings, strict=True):
                inside = (low >= floor) & (high <= ceiling)
                if np.count_nonzero(inside) >= self.limit:  # so many rows surely end inside, with at least this
                    floor = max(floor, np.partition(low[inside], -self.limit)[-self.limit])
                keep |= (high >= floor) & (low <= ceiling)
            alive, score = alive[keep], score[keep]
        if len(alive):
            self._merge(k, ids[alive], score.astype("i8"))

    def _merge(self, k: int, ids: np.ndarray, scores: np.ndarray) -> None:
        for w, (low, high) in enumerate(self.windows[k]):
            inside = (scores >= low) & (scores <= high)
            if inside.any():
                a, b = (np.concatenate(p) for p in zip(self.best[k][w], (ids[inside], scores[inside]), strict=True))
                first = np.lexsort((a, -b))[: self.limit]
                self.best[k][w] = a[first], b[first]

    def found(self, names: pa.Array, out: list[str]) -> pa.RecordBatch:
        """(anchor, window, id, score)."""
        at, ws, ids, scores = [], [], [], []
        for k, best in enumerate(self.best):
            for w, (i, s) in enumerate(best):
                at += [k] * len(i)
                ws += [w] * len(i)
                ids.append(i)
                scores.append(s)
        flat = [np.concatenate(c) if c else np.empty(0, "i8") for c in (ids, scores)]
        return pa.RecordBatch.from_arrays([names.take(pa.array(at, "i8")), pa.array(ws, "i4"), *map(pa.array, flat)], out)


def scan(anchors: DataFrame, stored: DataFrame, dim: int, same: bool, limit: int = LIMIT, n_anchors: int | None = None, n_blocks: int | None = None, anchor_rows: int = ANCHORS, groups: int = GROUPS) -> DataFrame:
    """(anchor, window, id, score): for each window of each anchor the best rows that each unit has found in stored blocks.

    anchors(anchor, id, label, x) and windows, an array of (low, high) scores. same tells whether rows of the anchor's own label are asked for,
    or of others.
    """
    n = max(1, -(-(anchors.count() if n_anchors is None else n_anchors) // anchor_rows))
    g = max(1, min(groups, stored.count() if n_blocks is None else n_blocks))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = anchors.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(n)).cast("int").alias("i")).agg(F.collect_list(F.struct("anchor", "id", "label", "x", "windows")).alias("asked"))
    dealt = dealt.select("i", every(g).alias("g"), F.lit(None).cast("long").alias("block"), "asked")
    # blocks in turn to the groups, by their place in the order of names
    placed = stored.select("block").withColumn("g", (F.row_number().over(Window.orderBy("block")) - 1) % g)  # a row for each block of rows
    rows = stored.join(F.broadcast(placed), "block") if g < groups else stored.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(g)).cast("int"))
    both = dealt.unionByName(rows.select(every(n).alias("i"), "*"), allowMissingColumns=True)
    both = both.select("i", "g", "block", "asked", "n", "ids", "labels", "width", "columns", "lows", "highs")
    kind = anchors.schema["anchor"].dataType.simpleString()
    names = ["anchor", "window", "id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unit, called = None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                asked = batch.column(3)[k]
                if asked.is_valid:  # a unit's anchors come before its blocks
                    if held:
                        yield held.found(called, names)
                    flat = asked.values
                    called, unit = flat.field("anchor"), (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())
                    x = np.frombuffer(b"".join(flat.field("x").to_pylist()), "<i4").reshape(-1, dim).astype("i8")
                    windows = [np.array([(w["low"], w["high"]) for w in ws], "i8").reshape(-1, 2) for ws in flat.field("windows").to_pylist()]
                    held = _Scan(flat.field("id").to_numpy(), flat.field("label").to_numpy(), x, same, windows, limit)
                elif held and unit == (batch.column(0)[k].as_py(), batch.column(1)[k].as_py()):
                    n, ids, labels, width, columns, lows, highs = (batch.column(c)[k].as_py() for c in range(4, 11))
                    held.block(np.frombuffer(ids, "i8"), np.frombuffer(labels, "i8"), np.frombuffer(columns, f"<i{width}").reshape(dim, n), np.frombuffer(lows, "i8"), np.frombuffer(highs, "i8"))
        if held:
            yield held.found(called, names)

    units = both.repartition("i", "g").sortWithinPartitions("i", "g", F.col("block").asc_nulls_first())
    return units.mapInArrow(run, f"anchor {kind}, window int, id long, score long")


def mined(rows: DataFrame, chosen: Column, limit: int = LIMIT, floor_share: int = LOW, key: str = "vec_id", label: str = "label", vector: str = "embedding", block_rows: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for the rows that `chosen` names, the hard
    negatives of each of their `limit` positives. chosen is a condition on the column `id`."""
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    dim = _dimension(rows, "vector")
    if not dim:
        return rows.sparkSession.createDataFrame([], out)
    stored = blocks(rows, dim, block_rows)
    asked = settled(anchors_of(rows, dim, chosen))
    counts = {"n_anchors": asked.count(), "n_blocks": stored.count()}
    if not all(counts.values()):
        return rows.sparkSession.createDataFrame([], out)
    first = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")

    def merged(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit)

    ends = (F.lit(-(2**62)), F.lit(2**62))
    window = lambda low, high: F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))
    positives = merged(scan(asked.withColumn("windows", F.array(window(*ends))), stored, dim, True, limit, **counts))
    held = settled(positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives")))  # `limit` at most
    # 100 * score >= floor_share * p, in whole numbers; of a negative p nothing is in the window
    low = lambda p: F.when(p < 0, F.lit(0)).otherwise(F.call_function("div", F.lit(floor_share) * p + 99, F.lit(100)))
    windows = asked.join(held, "anchor").withColumn("windows", F.transform("positives", lambda p: window(low(p["score"]), p["score"])))
    negatives = merged(scan(windows.drop("positives"), stored, dim, False, limit, **counts))
    named = held.select("anchor", F.posexplode("positives").alias("window", "positive"))
    joined = negatives.join(named, ["anchor", "window"])
    return joined.select(F.col("anchor.id").alias("anchor_id"), F.col("positive.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; where it is divisible by 7, the label is moved on by one first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.select("vec_id", label.alias("label"), "embedding"), F.col("id") % 100 == 0)


OP11_SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (select anchor_id, id as positive_id, score as positive_score from (select *, row_number() over (partition by anchor_id order by score desc, id) as r from scored where same) where r <= 5),
negatives as (select p.*, id as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, id) as r
  from positives p join scored s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, cast(r as int) as rank, negative_id, positive_score, negative_score from negatives where r <= 5"""
