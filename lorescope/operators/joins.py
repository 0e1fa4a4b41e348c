"""Joins and running sums that no hot key and no large table brings into one task."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import shared_dir

#: Rows at most of a table that is broadcast after its rows were counted; narrow rows, so some 100 MB.
BROADCAST_ROWS = 1_000_000
#: A key is hot from this number of rows on, or from one row in so many, if that is more: at most 10,000 keys are hot.
HOT_ROWS, HOT_SHARE = 500, 10_000


def settled(df: DataFrame) -> DataFrame:
    """Compute df once into the shared checkpoint folder and go on from there.

    For narrow rows. A lost executor costs a re-read, not a recomputation, and every later use
    sees the same rows in the same partitions.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_or_not(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A narrow table for the right side of a join: broadcast if it is counted small, else left to a shuffle."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def with_totals(left: DataFrame, totals: DataFrame, on: str, rows: int | None = None, n: str = "n") -> DataFrame:
    """left joined with totals, which has one row for each key and, in column n, how many rows of left have it.

    Rows of hot keys meet a broadcast of at most HOT_SHARE totals where they lie; only the others are shuffled,
    so that no key's rows come together in a task. n itself is dropped. rows: how many left has at most, if known.
    """
    rows = totals.agg(F.sum(n)).first()[0] or 0 if rows is None else rows
    least = max(HOT_ROWS, rows // HOT_SHARE)
    hot, others = totals.filter(F.col(n) >= least).drop(n), totals.filter(F.col(n) < least).drop(n)
    here = left.join(F.broadcast(hot), on)
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(others, on)
    return here.unionByName(rest)


def split_join(left: DataFrame, right: DataFrame, on: str, block: int = 2000) -> DataFrame:
    """The inner join of two tables that may both have many rows of a key.

    Rows are counted by key on either side. A hot key (see HOT_ROWS) is dealt into blocks of about `block` rows on both, each row
    of a block goes to all blocks of the other side, and so a key's result is made by as many tasks as it has pairs of blocks. Other keys
    are joined as they are. Null keys meet none.
    """
    counts = [settled(df.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias(n))) for df, n in ((left, "__l"), (right, "__r"))]
    least = [max(HOT_ROWS, (c.agg(F.sum(n)).first()[0] or 0) // HOT_SHARE) for c, n in zip(counts, ("__l", "__r"), strict=True)]
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    hot = settled(counts[0].join(counts[1], on).filter((F.col("__l") >= least[0]) | (F.col("__r") >= least[1])).select(on, blocks("__l").alias("__a"), blocks("__r").alias("__b")))
    one = F.lit(1)

    def dealt(df: DataFrame, mine: str, other: str, i: str, j: str) -> DataFrame:
        out = df.withColumn("__row", F.monotonically_increasing_id()).join(F.broadcast(hot), on, "left")  # at most 2 * HOT_SHARE keys
        out = out.withColumn(i, F.pmod(F.col("__row"), F.coalesce(mine, one)).cast("int"))
        return out.withColumn(j, F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1))).drop("__row", "__a", "__b")

    return dealt(left, "__a", "__b", "__i", "__j").join(dealt(right, "__b", "__a", "__j", "__i"), [on, "__i", "__j"]).drop("__i", "__j")


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with running sums (this row included) in the given order, which must be without ties.

    Two passes: rows are dealt out by range and summed within their partition, and the partitions' totals, one row
    each, give what stands before. A task holds some 10,000 rows, or a million where there are more than 10^8 of them.
    """
    n = df.count()
    parts = max(1, min(10_000, n // 10_000), n // 1_000_000)
    df = settled(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    totals = df.groupBy("__part").agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__part", *[F.coalesce(F.sum(f"__{k}").over(earlier), F.lit(0)).alias(f"__{k}") for k in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({k: F.sum(c).over(inside) for k, c in sums.items()}).join(F.broadcast(bases), "__part")  # a row for each task
    return df.withColumns({k: F.col(k) + F.col(f"__{k}") for k in sums}).drop("__part", *[f"__{k}" for k in sums])
