"""Column statistics, data quality and summaries of measurements."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import prefix_sums, settled, with_totals

#: Fixed value: a format whose share is measured.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


@dataclass(frozen=True)
class Rule:
    """What is expected of a column's values."""

    pattern: str | None = None
    cast: str | None = None
    low: float | None = None
    high: float | None = None
    standard: str | None = None


def completeness(c: Column) -> Column:
    return F.avg(c.isNotNull().cast("double"))


def validity(c: Column, pattern: str | None = None, cast: str | None = None) -> Column:
    """Share of the non-null values that match, or can be cast."""
    good = c.cast("string").rlike(pattern) if pattern else c.cast("string").try_cast(cast).isNotNull()
    return F.avg(F.when(c.isNotNull(), good.cast("double")))


def out_of_range(c: Column, low, high) -> Column:
    return F.count_if(~c.between(low, high))


def standardized(c: Column, pattern: str) -> Column:
    return F.count_if(c.cast("string").rlike(pattern))


def common_issues(complete: Column, valid: Column | None = None, outside: Column | None = None) -> Column:
    return F.array_compact(F.array(F.when(valid < 1, "invalid_format") if valid is not None else F.lit(None), F.when(complete < 1, "missing_values"), F.when(outside > 0, "out_of_range") if outside is not None else F.lit(None)))


def most_common(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """(column_name, most_common): up to k frequent values, ties by value. Counted in one pass, in long form."""
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(items.alias("i")).select("i.*").filter("value is not null").groupBy("column_name", "value").count()
    order = Window.partitionBy("column_name").orderBy(F.desc("count"), "value")
    best = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    return best.groupBy("column_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("most_common"))


def column_statistics(df: DataFrame, columns: list[str], k: int = 3, approximate: bool = False) -> DataFrame:
    """(column_name, min, max, avg, unique_count, most_common). Values are kept as text; avg is of numeric columns."""
    numeric = {c for c, kind in df.dtypes if kind in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.startswith("decimal")}
    unique = F.approx_count_distinct if approximate else F.count_distinct
    parts = [F.struct(F.lit(c).alias("column_name"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"), (F.round(F.avg(c), 4).cast("string") if c in numeric else F.lit(None).cast("string")).alias("avg"), unique(c).alias("unique_count")) for c in columns]
    rows = df.agg(*[p.alias(f"s{i}") for i, p in enumerate(parts)]).select(F.explode(F.array(*[f"s{i}" for i in range(len(parts))])).alias("s")).select("s.*")
    return rows.join(most_common(df, columns, k), "column_name", "left")


def quality_metrics(df: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """(column_name, completeness, validity, min_valid, max_valid, out_of_range_count, standardized_count, total_count, standard, common_issues)."""
    parts = []
    for name, rule in rules.items():
        c = F.col(name)
        complete = completeness(c)
        valid = validity(c, rule.pattern, rule.cast) if rule.pattern or rule.cast else F.lit(None).cast("double")
        outside = out_of_range(c, rule.low, rule.high) if rule.low is not None else F.lit(None).cast("long")
        std = standardized(c, rule.pattern) if rule.standard else F.lit(None).cast("long")
        total = F.count(c) if rule.standard else F.lit(None).cast("long")
        issues = common_issues(complete, valid, outside)
        fields = [F.lit(name).alias("column_name"), complete.alias("completeness"), valid.alias("validity"), F.lit(rule.low).cast("double").alias("min_valid"), F.lit(rule.high).cast("double").alias("max_valid"), outside.alias("out_of_range_count"), std.alias("standardized_count"), total.alias("total_count"), F.lit(rule.standard).cast("string").alias("standard"), issues.alias("common_issues")]
        parts.append(F.struct(*fields))
    found = df.agg(*[p.alias(f"q{i}") for i, p in enumerate(parts)])
    return found.select(F.explode(F.array(*[f"q{i}" for i in range(len(parts))])).alias("q")).select("q.*")


def profile_table(df: DataFrame, rules: dict[str, Rule], k: int = 3) -> DataFrame:
    """One row for each column, shaped as render_column() reads it: name, type, statistics, quality_metrics."""
    kinds = dict(df.dtypes)
    stats, quality = column_statistics(df, list(rules), k), quality_metrics(df, rules)
    out = stats.join(quality, "column_name")
    kind = F.coalesce(*[F.when(F.col("column_name") == c, F.lit(kinds[c])) for c in rules])
    ranged = F.when(F.col("min_valid").isNotNull(), F.struct(F.col("min_valid").cast("long").alias("min_valid"), F.col("max_valid").cast("long").alias("max_valid"), "out_of_range_count"))
    standard = F.when(F.col("standard").isNotNull(), F.struct("standardized_count", "total_count", "standard"))
    text = F.lit(None).cast("string")
    return out.select(
        F.col("column_name").alias("name"),
        kind.alias("type"),
        text.alias("basetype"),
        text.alias("description"),
        text.alias("table_id"),
        text.alias("bucket_id"),
        F.struct("min", "max", "avg", "unique_count", "most_common").alias("statistics"),
        F.struct("completeness", "validity", text.alias("format_pattern"), ranged.alias("range_check"), standard.alias("standardization"), "common_issues").alias("quality_metrics"),
    )


def percentiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column for each share): exact percentiles, linear between neighbours as F.percentile gives them.

    Equal values of a group are counted first. The counts are summed up in order by ranges, whatever the sizes of
    groups, and only the rows that hold a wanted rank go on, so that no task holds a group's values.
    """
    values = df.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("k"))
    summed = settled(prefix_sums(values, [by, "v"], {"upto": F.col("k")}))
    sizes = settled(summed.groupBy(by).agg(F.sum("k").alias("size"), F.min(F.col("upto") - F.col("k")).alias("base"), F.count("*").alias("n")))
    at = [((F.col("size") - 1) * F.lit(p)).alias(name) for name, p in shares.items()]
    ranked = with_totals(summed, sizes, by).withColumn("upto", F.col("upto") - F.col("base")).withColumn("from", F.col("upto") - F.col("k"))
    held = []
    for name, place in zip(shares, at, strict=True):
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            held.append(F.max(F.when((rank >= F.col("from")) & (rank < F.col("upto")), F.col("v"))).alias(f"{name}_{side}"))
    found = ranked.groupBy(by, "size").agg(*held)
    parts = [(F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (place - F.floor(place))).alias(name) for name, place in zip(shares, at, strict=True)]
    return found.select(by, *parts)


def latency_summary(df: DataFrame, by: str, value: str, approximate: bool = False) -> DataFrame:
    """p50, p95, p99, min, max, mean, std and sample_size for each operation."""
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    sums = [F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev(value).alias("std"), F.count(value).alias("sample_size")]
    if approximate:
        out = df.groupBy(by).agg(F.percentile_approx(value, F.array(*map(F.lit, shares.values()))).alias("q"), *sums)
        out = out.select("*", *[F.col("q")[k].alias(name) for k, name in enumerate(shares)])
    else:
        out = df.groupBy(by).agg(*sums).join(percentiles(df, by, value, shares), by, "left")
    return out.select(by, *shares, "min", "max", "mean", "std", "sample_size")


def throughput_summary(df: DataFrame, by: str, seconds: str) -> DataFrame:
    out = df.groupBy(by).agg(F.sum(seconds).alias("total_time"), F.count("*").alias("total_records"), F.min(seconds).alias("min"), F.avg(seconds).alias("mean"), F.max(seconds).alias("max"))
    return out.withColumn("records_per_second", F.col("total_records") / F.nullif("total_time", F.lit(0.0)))


def memory_summary(df: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    return df.groupBy(by).agg(F.min_by(value, F.struct(*order)).alias("initial"), F.max(value).alias("peak"), F.avg(value).alias("mean"), F.stddev(value).alias("std"), F.count(value).alias("total_samples"))
