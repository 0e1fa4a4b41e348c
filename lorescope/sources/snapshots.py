"""Reading exported snapshots, and keeping state as versioned Parquet."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.joins import settled, with_totals
from . import manifest
from .schemas import ENTITIES
from .shared import shared_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_entities(spark: SparkSession, path: str, entity: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Items of one entity kind from JSON lines, and the lines that are none: (entity, raw, reason)."""
    kind = T.StructType.fromDDL(schema or ENTITIES[entity]).add("__bad", T.StringType())
    lines = spark.read.text(path).filter(F.trim("value") != "")
    read = lines.select("value", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("item"))
    good = read.filter(F.col("item").isNotNull() & F.col("item.__bad").isNull()).select("item.*").drop("__bad")
    bad = read.filter(F.col("item").isNull() | F.col("item.__bad").isNotNull())
    return good, bad.select(F.lit(entity).alias("entity"), F.col("value").alias("raw"), F.lit("no valid item").alias("reason"))


def with_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """A row for each parent and child, with n_children; a parent whose children could not be read has one row with
    nulls and 0. parents has one row for each key.

    The long form: a parent with a third of all children is no row, list or task of its own.
    """
    counts = settled(children.groupBy(key).agg(F.count("*").alias("n")))
    known = parents.join(counts, key, "left").withColumn("n_children", F.coalesce("n", F.lit(0).cast("long")))
    some = with_totals(children, settled(known.filter("n is not null")), key)
    none = known.filter("n is null").drop("n")
    names = [*parents.columns, *[c for c in children.columns if c != key], "n_children"]
    return some.select(*names).unionByName(none, allowMissingColumns=True).select(*names)


def active_only(df: DataFrame, include_deleted: bool = False, flag: str = "isDeleted") -> DataFrame:
    """Without items marked as deleted; one without a mark is live."""
    return df if include_deleted else df.filter(~F.coalesce(F.col(flag), F.lit(False)))


def save_state(state: DataFrame, base: str) -> int:
    """Write a new version of the state; it counts once it is complete. Of two writers that start from one version the
    second fails, and its data is never read."""
    spark, at = state.sparkSession, f"{base}/data/{uuid.uuid4().hex}"
    found = manifest.versions(spark, base)
    state.write.parquet(at)
    return manifest.put(spark, base, found[-1] + 1 if found else 1, {"path": at})


def load_state(spark: SparkSession, base: str, schema: str = ENTITIES["state"]) -> DataFrame:
    """The newest complete version; without one, an empty state."""
    found = manifest.newest(spark, base)
    return spark.read.schema(schema).parquet(found[1]["path"]) if found else spark.createDataFrame([], schema)


def snapshot_summary(entities: dict[str, DataFrame]) -> DataFrame:
    """(entity, n)."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in entities.items()]
    return reduce(DataFrame.unionByName, parts)
