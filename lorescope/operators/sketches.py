"""Profiles that can be merged: what a snapshot's columns look like, kept by snapshot and added up without reading rows again.

A profile has a row for each column: numbers of rows and of values, least and greatest, the sum, and three sketches, of
different values (HyperLogLog, 4,096 registers: 1.6 % standard error), of quantiles (KLL with k = 800: a rank is off by under
0.5 % of the values with 99 % probability) and of frequent values (exact up to three quarters of TRACKED different values; beyond, a
count is too high by at most the values not tracked over TRACKED). All are aggregates of one pass, combined within tasks first.
"""

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import manifest

REGISTERS, KLL, TRACKED = 12, 800, 10_000
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def sketched(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The profile of df's columns. Quantiles are of numeric columns; a column without values has null for what is of values."""
    kinds = {c: kind for c, kind in df.dtypes if columns is None or c in columns}
    parts = []
    for name, kind in kinds.items():
        c, number = F.col(f"`{name}`"), kind in NUMERIC or kind.startswith("decimal")
        text = c.cast("string")
        parts.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count("*").alias("rows"),
                F.count(c).alias("filled"),
                (F.min(c) if number else F.min(text)).cast("string").alias("min"),
                (F.max(c) if number else F.max(text)).cast("string").alias("max"),
                F.lit(number).alias("numeric"),
                (F.sum(c.cast("double")) if number else F.lit(None).cast("double")).alias("total"),
                F.hll_sketch_agg(text, REGISTERS).alias("distinct"),
                (F.kll_sketch_agg_double(c.cast("double"), KLL) if number else F.lit(None).cast("binary")).alias("quantiles"),
                F.expr(f"approx_top_k_accumulate(cast(`{name}` as string), {TRACKED}) filter (where `{name}` is not null)").alias("top"),
            )
        )
    held = df.agg(*[p.alias(f"p{i}") for i, p in enumerate(parts)])
    return held.select(F.explode(F.array(*[f"p{i}" for i in range(len(parts))])).alias("p")).select("p.*")


def merged(profiles: DataFrame) -> DataFrame:
    """One profile of several (a union of profiles)."""
    number = lambda c: F.struct(F.col(c).try_cast("double"), F.col(c).try_cast("decimal(38,0)"))  # noqa: E731  long ones differ by less than a double tells
    least = F.when(F.any_value("numeric"), F.min_by("min", number("min"))).otherwise(F.min("min"))
    most = F.when(F.any_value("numeric"), F.max_by("max", number("max"))).otherwise(F.max("max"))
    return profiles.groupBy("column_name").agg(
        F.sum("rows").alias("rows"),
        F.sum("filled").alias("filled"),
        least.alias("min"),
        most.alias("max"),
        F.any_value("numeric").alias("numeric"),
        F.sum("total").alias("total"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.when(F.any_value("numeric"), F.kll_merge_agg_double("quantiles")).alias("quantiles"),
        F.expr(f"approx_top_k_combine(top, {TRACKED})").alias("top"),
    )


def estimated(profile: DataFrame, shares: tuple[float, ...] = (0.5, 0.95, 0.99), k: int = 3) -> DataFrame:
    """column_name, rows, completeness, min, max, avg, unique_count, quantiles and most_common (of equal counts the smaller value) of a profile."""
    some = F.col("filled") > 0
    asked = F.array(*[F.lit(float(s)) for s in shares])
    top = F.expr(f"approx_top_k_estimate(top, {4 * k})")  # ties are told apart among a few more
    best = F.slice(F.array_sort(top, lambda a, b: F.when(a["count"] != b["count"], F.when(a["count"] > b["count"], -1).otherwise(1)).when(a["item"] < b["item"], -1).when(a["item"] > b["item"], 1).otherwise(0)), 1, k)
    return profile.select(
        "column_name",
        "rows",
        (F.col("filled") / F.nullif("rows", F.lit(0))).alias("completeness"),
        "min",
        "max",
        F.when(F.col("numeric") & some, F.col("total") / F.col("filled")).alias("avg"),
        F.hll_sketch_estimate("distinct").alias("unique_count"),
        F.when(F.col("numeric") & some, F.kll_sketch_get_quantile_double("quantiles", asked)).alias("quantiles"),
        F.when(some, F.transform(best, lambda x: x["item"])).alias("most_common"),
    )


def held_against(found: DataFrame, df: DataFrame) -> DataFrame:
    """What estimated() gives with two shares, and, exactly, the rows' `distinct`, `filled`, and how many values are `under` the first quantile
    and how many `upto` the second. Equal values are counted first, column by column; no row is multiplied and no value is sorted."""
    marks = found.select("column_name", F.col("quantiles")[0].alias("low"), F.col("quantiles")[1].alias("high"))
    parts = []
    for name, kind in df.dtypes:
        number = F.col("v").cast("double") if kind in NUMERIC or kind.startswith("decimal") else F.lit(None).cast("double")
        parts.append(df.groupBy(F.col(f"`{name}`").alias("v")).agg(F.count("*").alias("n")).filter("v is not null").select(F.lit(name).alias("column_name"), number.alias("v"), "n"))
    counted = reduce(DataFrame.union, parts).join(F.broadcast(marks), "column_name")  # a row for each column
    exact = counted.groupBy("column_name").agg(F.count("*").alias("distinct"), F.sum("n").alias("filled"), *[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(a) for a, c in (("under", F.col("v") < F.col("low")), ("upto", F.col("v") <= F.col("high")))])
    return found.join(exact, "column_name", "left").fillna(0, ["distinct", "filled", "under", "upto"])


def save(profile: DataFrame, base: str, snapshot: str) -> int:
    """Keep a snapshot's profile; one of the same name is replaced."""
    spark, path = profile.sparkSession, f"{base}/data/{uuid.uuid4().hex}"
    profile.coalesce(1).write.parquet(path)  # a row for each column
    return manifest.commit(spark, base, lambda body: {"profiles": (body or {"profiles": {}})["profiles"] | {snapshot: path}})


def load(spark: SparkSession, base: str, snapshots: list[str] | None = None) -> DataFrame:
    """Profiles with their snapshot's name, all or those named, for merged(). KeyError for a name that is none."""
    found = manifest.newest(spark, base)
    held = found[1]["profiles"] if found else {}
    names = list(held) if snapshots is None else snapshots
    if not names:
        raise ValueError(f"no profiles at {base}")
    out = None
    for name in names:
        one = spark.read.parquet(held[name]).withColumn("snapshot", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
