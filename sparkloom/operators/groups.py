"""Grouped, ranked and set-shaped operators over any table. Every rank has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in the order; Spark limits the rank before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def first_occurrence(df: DataFrame, key: Column, order: list[Column], exempt: Column | None = None) -> DataFrame:
    """The first row of each key in the order; exempt rows always stay."""
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    out = df.withColumn("_key", key).withColumn("_rank", rank)
    keep = F.col("_rank") == 1
    return out.where(keep if exempt is None else keep | exempt).drop("_key", "_rank")


def mark_duplicates(df: DataFrame, key: Column, order: list[Column], name: str = "duplicate") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    return df.withColumn("_key", key).withColumn(name, rank > 1).drop("_key")


def previous_value(df: DataFrame, group: list[str], order: list[Column], value: str, counts: Column) -> Column:
    """The value of the last earlier row of the group that counts."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(counts, F.col(value)), ignorenulls=True).over(w)


def carry_forward(group: list[str], order: list[Column], value: Column) -> Column:
    """The last value that isn't null, up to and with this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def zero_filled_counts(df: DataFrame, column: str, domain: list[str], others: Column | None = None) -> DataFrame:
    """Rows of each value of a fixed domain, 0 included, and of all."""
    found = df.groupBy(column).agg(F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame([(d,) for d in domain], f"{column} string")
    filled = names.join(found, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return filled.withColumn("total", F.sum("n").over(Window.partitionBy()))


def facet_counts(df: DataFrame, facet: str, filters: dict[str, Column]) -> DataFrame:
    """Counts by a facet under all filters but the facet's own; null is a value of its own."""
    for name, test in filters.items():
        if name != facet:
            df = df.where(test)
    return df.groupBy(F.coalesce(F.col(facet), F.lit("none")).alias(facet)).agg(F.count("*").alias("n"))


def fill_rates(df: DataFrame, group: list[str], fields: dict[str, Column], digits: int = 2) -> DataFrame:
    """Share of rows of each group in which a field is present."""
    rates = [F.round(F.avg(F.coalesce(test, F.lit(False)).cast("double")), digits).alias(name) for name, test in fields.items()]
    return df.groupBy(*group).agg(F.count("*").alias("n"), *rates)


def page(df: DataFrame, order: list[Column], number: int, size: int, most: int = 100) -> DataFrame:
    """One page of an ordered listing."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, 0 of nothing."""
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


def whole_mean(value: Column) -> Column:
    """Aggregate: the mean as the nearest integer, halves away from zero; values count to nine decimals.

    Sums are exact, so a mean of exactly a half doesn't depend on the order in which partial sums of doubles meet.
    """
    total, n = F.sum(value.cast("decimal(20,9)")), F.count(value).cast("decimal(19,0)")
    up, unit = F.abs(total) * 2 + n, F.nullif(n * 2, F.lit(0))
    return (F.signum(total) * ((up - up % unit) / unit)).cast("int")


def severity_max(status: Column, order: list[str]) -> Column:
    """Aggregate: the status that stands last in the order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), status)
    return F.max_by(status, rank)


def full_diff(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values that one side lacks, with the side that has them."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    return x.join(y, column, "left_anti").withColumn("side", F.lit("left")).union(y.join(x, column, "left_anti").withColumn("side", F.lit("right")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
