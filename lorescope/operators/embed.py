"""Embedding through a pluggable batch provider."""

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources import manifest, points
from .joins import settled, with_totals

Provider = Callable[[list[str]], list[list[float]]]
#: Rows that go on from a task at once.
ROWS = 1000


def batched(items: Sequence, size: int) -> Iterator[Sequence]:
    for k in range(0, len(items), size):
        yield items[k : k + size]


def with_retries(fn: Callable, retries: int = 3, delay: float = 1.0, factor: float = 2.0, most: float = 60.0, sleep: Callable = time.sleep):
    """fn, called again after a failure up to `retries` times with growing delays; then the error is raised."""

    def run(*args):
        wait = delay
        for left in range(retries, -1, -1):
            try:
                return fn(*args)
            except Exception:
                if not left:
                    raise
                sleep(min(wait, most))
                wait *= factor

    return run


def embed(df: DataFrame, text: str, make: Callable[[], Provider], batch_size: int = 10, retries: int = 3, delay: float = 1.0) -> DataFrame:
    """df with `vector` (array<float>). `make` builds the provider once for each task; a provider that
    gives another number of vectors than texts is an error."""

    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = with_retries(make(), retries, delay)
        for whole in batches:
            for rows in batched(range(whole.num_rows), max(1, ROWS // batch_size) * batch_size):
                vectors = []
                for few in batched(rows, batch_size):
                    texts = whole.column(at).slice(few[0], len(few)).to_pylist()  # copied for one call only
                    found = call(texts)
                    if len(found) != len(texts):
                        raise ValueError(f"{len(texts)} texts, {len(found)} vectors")
                    vectors.append(pa.array(found, pa.list_(pa.float32())))
                part = whole.slice(rows[0], len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.concat_arrays(vectors)], [*part.schema.names, "vector"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))


def embed_stored(df: DataFrame, text: str, make: Callable[[], Provider], base: str, dim: int, model: str = "default", batch_size: int = 10, retries: int = 3, delay: float = 1.0) -> DataFrame:
    """df with `vector`, from a store at `base` that is keyed by model and text; null texts count as empty.

    Only texts that the store has not are sent to the provider, each once, however often it stands in df, and then
    kept: a collection of points whose ids are hashes. What is known is found out by hashes alone; vectors meet their rows by a
    join that no common text brings into one task. ValueError if the provider gives vectors of another dimension.
    """
    spark = df.sparkSession
    words = F.coalesce(F.col(text), F.lit(""))
    keyed = df.withColumn("__key", F.sha2(F.concat(F.lit(model), F.lit("\0"), words), 256))
    counts = settled(keyed.groupBy(F.col("__key").alias("id")).agg(F.count("*").alias("n")))
    known = None if points.is_empty(spark, base) else points.load_points(spark, base).select("id")
    new = counts.select("id") if known is None else counts.select("id").join(known, "id", "left_anti")
    new = settled(new.withColumn("n", F.lit(1)))
    if new.take(1):
        # the first row of each new text, so that a common one goes on from its tasks as one row
        texts = keyed.select(F.col("__key").alias("id"), words.alias("text")).join(new.select("id"), "id", "left_semi").groupBy("id").agg(F.any_value("text").alias("text"))
        vectors = embed(texts, "text", make, batch_size, retries, delay).withColumn("metadata_type", F.lit(model)).select("id", "metadata_type", "vector")
        _, bad = points.upsert_points(base, vectors, ["id"], dim)
        if wrong := bad.take(1):
            raise ValueError(wrong[0]["reason"])
    if manifest.newest(spark, base) is None:  # no rows, and nothing stored
        return df.limit(0).withColumn("vector", F.array().cast("array<float>"))
    held = points.load_points(spark, base).select(F.col("id").alias("__key"), "vector").join(counts.withColumnRenamed("id", "__key"), "__key")
    return with_totals(keyed, held, "__key").select(*df.columns, "vector")
