"""Whitening of embeddings by spectral divide and conquer.

Entries become whole numbers, floor(256 * c). Each distinct vector counts once: its number and sums come from one
pass, the covariance, centred before it is multiplied, from a second. A shifted covariance A - sI has an orthogonal polar factor U
(QDWH: dynamically weighted Halley steps by QR), and (U + I) / 2 projects on the components whose eigenvalue is over s.
A basis of that subspace and one of the rest cut the covariance in two, and so on until each part is one component. Parts without
a wanted component are not cut further. The components go to every task with the code and whiten the rows there.

The driver holds matrices of dimension x dimension, sums of what tasks send; no vector.

Defined results. Rows whose vector is null, empty, or has null or non-finite entries, and those of another length than most
rows have (of equally many, the longest), take no part. Entries beyond 32 signed bits after scaling count as the last that fits. Repeated rows are whitened as often
as they come and counted once. A direction in which the vectors do not differ (eigenvalue under 1e-12 of the first for each dimension) is no component:
of vectors that are all equal, one included, and of an empty table there is no row. Components of equal eigenvalues are any orthonormal
basis. deviation is null where it leaves a long. Only the id and the vector are read.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import settled

SCALE = 256
#: An eigenvalue under this share of the largest, times the dimension, is none.
LEAST = 1e-12
MOST = 2**31


def polar(a: np.ndarray, steps: int = 20) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH steps of which each is a QR of twice the height."""
    n, size = len(a), np.linalg.norm(a, 2)
    if size == 0:
        return np.eye(n)
    x, low = a / size, np.finfo(float).eps / n  # low: under the least singular value, or as good as zero
    eye = np.eye(n)
    for _ in range(steps):
        l2 = low * low
        d = (4 * (1 - l2) / l2**2) ** (1 / 3)
        p = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * np.sqrt(1 + d)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))
        new = q / r * x + (p - q / r) / np.sqrt(r) * both[:n] @ both[n:].T
        low = min(1.0, low * (p + q * l2) / (1 + r * l2))
        done = np.linalg.norm(new - x) <= 1e-10 * np.sqrt(n) and 1 - low < 1e-12
        x = new
        if done:
            break
    return (x + x.T) / 2


def _halves(a: np.ndarray, tries: int = 8) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of a's invariant subspaces over and under a shift; None if all eigenvalues are equal as far as doubles tell."""
    n, mean = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    if spread <= 4 * np.finfo(float).eps * n * np.linalg.norm(a, 2):
        return None
    best = None
    for k in range(tries):
        # the mean has eigenvalues on both sides; where one lies on it, the next shift is a little off
        shift = mean + spread * 0.37 * ((k + 1) // 2) / tries * (-1) ** k
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n:
            continue
        # a projector's image, by two QR steps from fixed directions, and what is orthogonal to it
        start = np.random.default_rng(n).standard_normal((n, n))
        q, _ = np.linalg.qr(np.hstack([projector @ start[:, :rank], start[:, rank:] - projector @ start[:, rank:]]))
        q, _ = np.linalg.qr(np.hstack([projector @ q[:, :rank], q[:, rank:] - projector @ q[:, rank:]]))
        off = np.linalg.norm(q[:, :rank].T @ a @ q[:, rank:])
        if best is None or off < best[0]:
            best = off, q[:, :rank], q[:, rank:]
        if off <= 8 * np.finfo(float).eps * n * np.linalg.norm(a, 2):
            break
    return best[1:] if best else None


def components(cov: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns, of a symmetric matrix: the `wanted` first, or all."""
    dim = len(cov)
    wanted = dim if wanted is None else min(wanted, dim)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    parts = [np.eye(dim)]  # bases of invariant subspaces, those of larger eigenvalues last
    while parts and len(values) < wanted:
        basis = parts.pop()
        own = basis.T @ cov @ basis
        own = (own + own.T) / 2
        cut = _halves(own) if basis.shape[1] > 1 else None
        if cut is None:
            values += list(np.diag(own))
            vectors.append(basis)
            continue
        parts += [basis @ cut[1], basis @ cut[0]]
    v = np.hstack(vectors)[:, :wanted]
    v, r = np.linalg.qr(v)
    v = v * np.where(np.diag(r) < 0, -1, 1)
    e = np.einsum("ij,ij->j", v, cov @ v)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector x of whole numbers: (n * x - sums) / n, times vectors / sqrt(values)."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def dim(self) -> int:
        return len(self.sums)


def whole(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and those as whole numbers."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False).to_numpy(zero_copy_only=False)
    m = vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
    finite = np.isfinite(m).all(axis=1)
    fits[fits] = finite
    return fits, np.clip(np.floor(SCALE * m[finite]), -MOST, MOST - 1).astype("i8")


def _dimension(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have."""
    counts = rows.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), F.desc("dim")).first()
    return first["dim"] if first else 0


def _distinct(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """Each vector of whole numbers once, as bytes. Equal ones meet in their tasks first, so that copies are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = whole(batch.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())], ["x"])

    return rows.select(vector).mapInArrow(run, "x binary").distinct()


def _of_bytes(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype("i8")


def _summed(distinct: DataFrame, dim: int, part) -> np.ndarray | None:
    """part(vectors) gives a matrix for some vectors; their sum over all, None without a vector.

    A task sends one matrix. Of p tasks' matrices groups of some sqrt(p) are added in tasks, and the groups' sums by the driver,
    both in the order of tasks, so that reruns agree.
    """
    kind, shape = (m := part(np.zeros((1, dim), "i8"))).dtype, m.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                m = part(_of_bytes(batch.column(0).slice(k, 4096), dim))
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], "i4"), pa.array([total.tobytes()], pa.binary())], ["task", "m"])

    def added(rows: list[tuple[int, bytes]]) -> np.ndarray:
        return sum(np.frombuffer(m, kind).reshape(shape) for _, m in sorted(rows, key=lambda r: r[0]))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, m) for batch in batches for t, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([min(t for t, _ in rows)], "i4"), pa.array([added(rows).tobytes()], pa.binary())], ["task", "m"])

    groups = int(distinct.rdd.getNumPartitions() ** 0.5) + 1
    out = "task int, m binary"
    found = distinct.mapInArrow(partial, out).repartition(groups, F.col("task") % groups).mapInArrow(grouped, out).collect()
    return added([(r["task"], r["m"]) for r in found]) if found else None


def fit(rows: DataFrame, vector: str = "embedding", wanted: int | None = None) -> Whitening | None:
    """The whitening of the distinct vectors of rows; None if none takes part or all are equal."""
    dim = _dimension(rows, vector)
    if not dim:
        return None
    distinct = settled(_distinct(rows, vector, dim))
    # high and low parts apart, so that no sum leaves a long
    first = _summed(distinct, dim, lambda x: np.vstack([(x >> 16).sum(axis=0), (x & 0xFFFF).sum(axis=0), np.full(dim, len(x))]))
    if first is None:
        return None
    n, sums = int(first[2, 0]), tuple((int(a) << 16) + int(b) for a, b in zip(first[0], first[1], strict=True))
    mean, rest = np.array([s // n for s in sums], "f8"), np.array([s % n for s in sums], "f8") / n

    def centred(x: np.ndarray) -> np.ndarray:
        return x - mean - rest

    cov = _summed(distinct, dim, lambda x: centred(x).T @ centred(x)) / n
    cov, trace = (cov + cov.T) / 2, float(np.trace(cov))
    if trace <= 0:
        return None
    values, vectors = components(cov, wanted)
    there = values > LEAST * dim * values[0]
    values, vectors = values[there], vectors[:, there]
    scaled = vectors / np.sqrt(values)
    k = len(values)

    def squares(x: np.ndarray) -> np.ndarray:
        z = centred(x) @ scaled
        return np.vstack([z.T @ z, z.sum(axis=0)])

    found = _summed(distinct, dim, squares) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    return Whitening(n, sums, values, vectors, trace, error)


def whitened(rows: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each row of rows that takes part and each component: key, component, n, deviation, whitened, explained, identity_error."""
    kind = rows.schema[key].dataType.simpleString()
    out = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], out)
    n, dim, k = model.n, model.dim, len(model.values)
    sums, scaled, explained = np.array(model.sums, object), model.vectors / np.sqrt(model.values), model.values / model.trace
    mean, rest = np.array([s // n for s in model.sums], "f8"), np.array([s % n for s in model.sums], "f8") / n
    small = float(max(map(abs, model.sums), default=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 4096):
                batch = whole_batch.slice(at, 4096)
                fits, x = whole(batch.column(1), dim)
                if (n * np.abs(x).max(initial=0).astype("f8") + small) ** 2 * dim < 2**62:
                    deviation = ((n * x - sums.astype("i8")) ** 2).sum(axis=1)
                else:
                    exact = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
                    deviation = [d if d < 2**63 else None for d in exact]
                z = (x - mean - rest) @ scaled
                ids = batch.column(0).filter(pa.array(fits))
                m = len(x)
                columns = [ids.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), "i4"), pa.array(np.full(m * k, n), "i8"), pa.array(deviation, "i8").take(pa.array(np.repeat(np.arange(m), k))), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(key, vector).mapInArrow(run, out)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitened(rows, fit(rows, wanted=4))
