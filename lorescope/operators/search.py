"""Top-k search by cosine similarity, filtered by metadata. Ties go by point id."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.vectors import cosine

#: Points of one block of a product, and queries that go with the code at most.
BLOCK = 4096
#: Numbers of one side of a unit of work of the all-pairs product, which holds two sides, and groups that a side is dealt into at least.
NUMBERS, GROUPS = 2**21, 8
#: Queries and points of a product that is made at once, and numbers of the pairs that are scored again at once.
TILE, PAIRS = (512, 2048), 2**20


def groups(n: int, dim: int, block: int = BLOCK, least: int = GROUPS) -> int:
    """Groups that n points are dealt into: of `block` points up to `least` groups, and of as many as a unit of work can hold beyond. A
    point goes once to each group of the other side, so few groups move little."""
    return max(1, min(-(-n // block), least), -(-n * dim // NUMBERS))


def metadata_filter(metadata_type: str | None = None, component_type: str | None = None, table_id: str | None = None, stage: str | None = None, component: str = "component_type", stage_column: str = "stage") -> Column:
    """AND of the equalities that are given. A table's own id is its table id."""
    found = F.lit(True)
    if metadata_type is not None:
        found = found & (F.col("metadata_type") == metadata_type)
    if component_type is not None:
        found = found & (F.col(component) == component_type)
    if table_id is not None:
        found = found & (F.col("table_id" if metadata_type == "columns" else "id") == table_id)
    if stage is not None:
        found = found & (F.col(stage_column) == stage)
    return found


def stage_of(stage: Column, bucket_stage: Column, id_: Column) -> Column:
    """Its own stage, else its bucket's, else the first part of the id."""
    return F.coalesce(stage, bucket_stage, F.substring_index(id_, ".", 1))


def top_k(points: DataFrame, query: list[float], limit: int = 10, exclude: Column | None = None) -> DataFrame:
    """points with score, the best `limit`; a query is a vector of the driver's."""
    q = F.array(*[F.lit(float(x)) for x in query])
    found = points if exclude is None else points.filter(~exclude)
    return found.withColumn("score", cosine(F.col("vector"), q)).orderBy(F.desc("score"), "id").limit(limit)


def semantic_search(points: DataFrame, query: list[float], limit: int = 10, **conditions) -> DataFrame:
    return top_k(points.filter(metadata_filter(**conditions)), query, limit)


def similar_to(points: DataFrame, base: DataFrame, limit: int = 10, among: Column | None = None) -> DataFrame:
    """The nearest to a stored point (base: id, vector; one row, or none for an empty result), without itself."""
    one = base.select(F.col("id").alias("__base"), F.col("vector").alias("__query")).limit(1)
    found = points if among is None else points.filter(among)
    found = found.join(F.broadcast(one), F.col("id") != F.col("__base"))  # one row
    return found.withColumn("score", cosine(F.col("vector"), F.col("__query"))).orderBy(F.desc("score"), "id").limit(limit).drop("__base", "__query")


def similar_columns(points: DataFrame, name: str, table_id: str, limit: int = 10) -> DataFrame:
    """Columns of any table nearest to a column; ValueError if there is no such column."""
    columns = F.col("metadata_type") == "columns"
    base = points.filter(columns & (F.col("name") == name) & (F.col("table_id") == table_id)).orderBy("id").select("id", "vector").limit(1)
    if not base.take(1):
        raise ValueError(f"no column {name} in {table_id}")
    return similar_to(points, base, limit, columns)


def table_columns(points: DataFrame, table_id: str, query: list[float] | None = None, limit: int = 100) -> DataFrame:
    own = points.filter((F.col("metadata_type") == "columns") & (F.col("table_id") == table_id))
    return own.orderBy("id").limit(limit) if query is None else top_k(own, query, limit)


def related_transformations(points: DataFrame, table_id: str, embed: Callable[[str], list[float]], limit: int = 5) -> DataFrame:
    """Transformations nearest to the text `table <table_id>`; embed gives a text's vector."""
    return semantic_search(points, embed(f"table {table_id}"), limit, metadata_type="transformations")


def _ranked(scored: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def _matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of length 1; zeros stay."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _distinct(y: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of rows of which at most so many before them are the same vector; ids are in order, so the others can't be among the best."""
    most += int(np.unique(ids, return_counts=True)[1].max(initial=1)) - 1  # rows of one id are left out together
    if len(y) <= most:
        return np.arange(len(y))
    same = np.unique(y.view(f"V{y.dtype.itemsize * y.shape[1]}").ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(same, kind="stable")
    first = np.searchsorted(same[order], same[order], "left")
    return np.sort(order[np.arange(len(y)) - first < most])


def _best(own: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, limit: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query ids, ids and scores of the `limit` best of each query, ties by id.

    Products are made tile by tile in single precision; what could be among the best within its error is scored again in double
    precision. So memory is that of the two sides and a tile, and few scores are sorted. Rows without finite numbers find nothing.
    """
    order = np.argsort(ids, kind="stable")
    ids, y = ids[order], np.ascontiguousarray(y[order])
    sound, there = np.isfinite(x).all(axis=1), np.isfinite(y).all(axis=1)
    ids, y, own, x = ids[there], y[there], own[sound], np.ascontiguousarray(x[sound])
    kept = _distinct(y, ids, limit + 1)
    ids, y = ids[kept], np.ascontiguousarray(y[kept])
    dim, few = x.shape[1] if x.ndim > 1 else 1, limit + 1 + int(np.unique(ids, return_counts=True)[1].max(initial=1))
    slack, x4, y4 = np.float32(4 * (dim + 4) * 2.0**-24), x.astype("f4"), y.astype("f4")
    parts = []

    def exact(q: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of places with their scores, without those of a query with itself."""
        if exclude_self:
            other = own[q] != ids[k]
            q, k = q[other], k[other]
        step = max(1, PAIRS // dim)
        score = [np.einsum("nd,nd->n", x[q[i : i + step]], y[k[i : i + step]]) for i in range(0, len(q), step)]
        return q, k, np.round(np.concatenate(score), 12) if score else np.zeros(0)

    def top(q: np.ndarray, k: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by = np.lexsort((k, -score, q))
        q, k, score = q[by], k[by], score[by]
        good = np.arange(len(q)) - np.searchsorted(q, q, "left") < limit
        return q[good], k[good], score[good]

    zero = np.flatnonzero(~x.any(axis=1))  # all scores are 0
    parts.append(top(*exact(np.repeat(zero, min(few, len(ids))), np.tile(np.arange(min(few, len(ids))), len(zero)))))
    asking = np.flatnonzero(x.any(axis=1))
    for start in range(0, len(asking), TILE[0]):
        rows = asking[start : start + TILE[0]]
        q4, least, best = x4[rows], np.full(len(rows), -np.inf, "f4"), (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))
        for at in range(0, len(ids), TILE[1]):
            score = q4 @ y4[at : at + TILE[1]].T
            if not at and score.shape[1] > few:
                least = np.partition(score, -few, axis=1)[:, -few]
            r, c = np.divmod(np.flatnonzero(score >= (least - slack)[:, None]), score.shape[1])
            for i in range(0, len(r), PAIRS):  # one part as a rule
                best = top(*(np.concatenate(pair) for pair in zip(best, exact(rows[r[i : i + PAIRS]], c[i : i + PAIRS] + at), strict=True)))
            n = np.bincount(np.searchsorted(rows, best[0]), minlength=len(rows))
            full = n >= limit
            least[full] = np.maximum(least[full], best[2][np.cumsum(n)[full] - 1].astype("f4"))
        parts.append(best)
    q, k, score = (np.concatenate(c) for c in zip(*parts, strict=True))
    return own[q], ids[k], score


def product(dim: int, limit: int, exclude_self: bool) -> Callable[[pa.Table], pa.Table]:
    """For a group of rows (key, vector, side: 0 asks, 1 is found): the best of each query, as (query_id, id, score)."""

    def run(part: pa.Table) -> pa.Table:
        sides = [part.filter(pc.equal(part.column("side"), s)).combine_chunks() for s in (0, 1)]
        keys, vectors = ([s.column(c) for s in sides] for c in ("key", "vector"))
        x, y = (_matrix(pa.concat_arrays(v.chunks) if v.num_chunks else pa.array([], v.type), dim) for v in vectors)
        if not len(x) or not len(y):
            return pa.table({"query_id": keys[0].slice(0, 0), "id": keys[1].slice(0, 0), "score": pa.array([], pa.float64())})
        found = _best(keys[0].to_numpy(), x, keys[1].to_numpy(), y, limit, exclude_self)
        return pa.table(dict(zip(["query_id", "id", "score"], map(pa.array, found), strict=True)))

    return run


def batch_search(points: DataFrame, queries: DataFrame, limit: int = 10, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank): exact top-k of queries(query_id, vector) among points(id, vector).

    Up to `block` queries go to every task with the code, and points stay where they are. Of more, both sides are dealt
    into groups (`groups`), and each pair of groups is one task's product, made tile by tile. Either way a product gives `limit` rows a
    query, whose best are merged; scores of all pairs never leave a task. Points and queries without a vector, or
    with one of another dimension than the first query's, find nothing.
    """
    asked = queries.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    first = asked.limit(block + 1).toArrow()  # at most block + 1 vectors
    kind, asked_kind = points.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    out = f"query_id {asked_kind}, id {kind}, score double"
    if not first.num_rows:
        return _ranked(points.sparkSession.createDataFrame([], out), limit)
    dim = len(first.column("vector")[0])
    alike = F.col("vector").isNotNull() & (F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull())
    asked, points = asked.filter(alike), points.filter(alike).select("id", "vector")
    names = ["query_id", "id", "score"]

    if first.num_rows <= block:
        first = first.filter(pc.equal(pc.list_value_length(first.column("vector")), dim)).combine_chunks()
        own, x = first.column("query_id").combine_chunks().to_numpy(zero_copy_only=False), _matrix(first.column("vector").combine_chunks(), dim)

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for k in range(0, whole.num_rows, BLOCK):
                    part = whole.slice(k, BLOCK)
                    found = _best(own, x, part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), dim), limit, exclude_self)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)

        return _ranked(points.mapInArrow(products, out), limit)

    a, b = groups(asked.count(), dim, block), groups(points.count(), dim, block)

    def dealt(df: DataFrame, key: str, own: int, other: int, side: int) -> DataFrame:
        mine, all_ = F.pmod(F.xxhash64(key), F.lit(own)), F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        df = df.select(F.col(key).alias("key"), "vector", F.lit(side).alias("side"), mine.cast("int").alias("mine"), all_.alias("other"))
        return df.select("key", "vector", "side", *([F.col("mine").alias("i"), F.col("other").alias("j")] if side == 0 else [F.col("other").alias("i"), F.col("mine").alias("j")]))

    both = dealt(asked, "query_id", a, b, 0).union(dealt(points, "id", b, a, 1))
    return _ranked(both.groupBy("i", "j").applyInArrow(product(dim, limit, exclude_self), out), limit)


def store_blocks(points: DataFrame, path: str, block: int = BLOCK) -> str:
    """Write points(id, vector) as blocks of a matrix each, for batch_search_blocks(): their ids, the numbers as they are, and the rows'
    lengths. Vectors of another dimension than most (of equally many, the longest), and those with nulls, are left out."""
    alike = points.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())).select("id", "vector")
    most = alike.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = most["dim"] if most else 0
    width = "<f4" if points.schema["vector"].dataType.elementType.simpleString() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, block):
                ids, vectors = whole.slice(k, block).columns
                m = vectors.flatten().to_numpy(zero_copy_only=False).astype(width).reshape(-1, dim)
                lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], "i4"), ids)
                yield pa.RecordBatch.from_arrays([lists, pa.array([dim], "i4"), pa.array([width]), pa.array([m.tobytes()], pa.binary()), pa.array([np.linalg.norm(m.astype("f8"), axis=1).tobytes()], pa.binary())], ["ids", "dim", "width", "matrix", "lengths"])

    kind = points.schema["id"].dataType.simpleString()
    alike.filter(F.size("vector") == dim).mapInArrow(run, f"ids array<{kind}>, dim int, width string, matrix binary, lengths binary").write.parquet(path)
    return path


def _rows(stored: DataFrame) -> DataFrame:
    """Points(id, vector) of stored blocks."""
    kind = stored.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, dim, width, matrix = (batch.column(c)[k] for c in ("ids", "dim", "width", "matrix"))
                m = np.frombuffer(matrix.as_py(), width.as_py()).astype("f8")
                yield pa.RecordBatch.from_arrays([ids.values, pa.ListArray.from_arrays(pa.array(np.arange(0, len(m) + 1, dim.as_py()), "i4"), pa.array(m))], ["id", "vector"])

    return stored.mapInArrow(run, f"id {kind}, vector array<double>")


def batch_search_blocks(spark: SparkSession, path: str, queries: DataFrame, limit: int = 10, exclude_self: bool = False, most: int | None = None) -> DataFrame:
    """batch_search() over stored blocks: up to BLOCK queries(query_id, vector) go with the code, to one product a block and nothing to decode.
    Of more, the blocks' points are dealt out as batch_search() does. ValueError beyond `most` queries, if that is given."""
    here = BLOCK if most is None else most
    sound = queries.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    asked = sound.limit(here + 1).toArrow()  # at most here + 1 vectors
    if asked.num_rows > here:
        if most is not None:
            raise ValueError(f"more than {most} queries")
        stored = spark.read.parquet(path)
        first = stored.select("dim").first()
        return batch_search(_rows(stored), sound.filter(F.size("vector") == (first["dim"] if first else -1)), limit, exclude_self)
    stored = spark.read.parquet(path)
    out = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {stored.schema['ids'].dataType.elementType.simpleString()}, score double"
    if not asked.num_rows:
        return _ranked(spark.createDataFrame([], out), limit)
    sizes = pc.list_value_length(asked.column("vector"))
    by_dim = {d: asked.filter(pc.equal(sizes, d)).combine_chunks() for d in pc.unique(sizes).to_pylist()}
    sides = {d: (t.column("query_id").combine_chunks().to_numpy(zero_copy_only=False), _matrix(t.column("vector").combine_chunks(), d)) for d, t in by_dim.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, dim, width, matrix, lengths = (c[k] for c in batch.columns)
                if dim.as_py() not in sides:
                    continue
                y, n = np.frombuffer(matrix.as_py(), width.as_py()).reshape(-1, dim.as_py()).astype("f8"), np.frombuffer(lengths.as_py(), "f8")
                y /= np.where(n == 0, 1, n)[:, None]
                found = _best(sides[dim.as_py()][0], sides[dim.as_py()][1], ids.values.to_numpy(zero_copy_only=False), y, limit, exclude_self)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "id", "score"])

    return _ranked(stored.mapInArrow(run, out), limit)


def all_similar(points: DataFrame, limit: int = 5, block: int = BLOCK) -> DataFrame:
    """The nearest others of every point, exactly."""
    return batch_search(points, points.select(F.col("id").alias("query_id"), "vector"), limit, True, block)


def format_hits(hits: DataFrame, fields: list[str]) -> DataFrame:
    """rank, score to three decimals, and the fields that the hits have."""
    order = Window.orderBy(F.desc("score"), "id")  # over k rows
    return hits.select(F.row_number().over(order).alias("rank"), F.format_string("%.3f", F.col("score")).alias("score_text"), "id", *[f for f in fields if f in hits.columns and f != "id"])


def quality_search(columns: DataFrame, completeness_below: float | None = None, issue: str | None = None) -> DataFrame:
    """Columns by their quality_metrics."""
    q, found = F.col("quality_metrics"), F.lit(True)
    if completeness_below is not None:
        found = found & (q["completeness"] < completeness_below)
    if issue is not None:
        found = found & F.array_contains(q["common_issues"], issue)
    return columns.filter(found)
