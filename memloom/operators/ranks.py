"""Numbers and order statistics of large groups: a group may hold any share of the rows, no task sorts it alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.sources.scratch import cut


def numbered(df: DataFrame, order: list[str], *, group: list[str] | None = None, name: str = "seq", start: int = 0) -> DataFrame:
    """``df`` with ``name``: the place of each row, from ``start`` + 1, in the ascending order of its columns ``order``,
    within its group (columns that aren't null). Rows are dealt by ranges of (group, order), numbered within their
    range, and the sizes of the ranges before are added; these are at most one row for each range and group."""
    keys = list(group or [])
    dealt = df.repartitionByRange(*keys, *order).withColumn("range_", F.spark_partition_id())
    dealt = cut(dealt, "numbered")
    sizes = dealt.groupBy(*keys, "range_").agg(F.count("*").alias("size_"))
    before = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before_", F.coalesce(F.sum("size_").over(before), F.lit(0))).drop("size_")
    place = F.row_number().over(Window.partitionBy(*keys, "range_").orderBy(*order))
    return dealt.withColumn(name, place.cast("bigint")).join(sizes, [*keys, "range_"]).withColumn(name, F.col(name) + F.col("before_") + start).drop("range_", "before_")


def order_statistics(df: DataFrame, value: str, places: dict, *, group: list[str]) -> DataFrame:
    """The group columns, n, mean, and for each name of ``places`` the value at that place (a column over n, from 1)
    of the group's ascending values. Null values are left out."""
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("v_"))
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg("v_").alias("mean"))
    wanted = sizes.select(*group, F.explode(F.array(*[F.struct(F.lit(k).alias("name_"), p.cast("bigint").alias("seq")) for k, p in places.items()])).alias("x")).select(*group, "x.*")
    found = numbered(rows, ["v_"], group=group).join(F.broadcast(wanted), [*group, "seq"])  # a few rows for each group
    picked = found.groupBy(*group).agg(*[F.max(F.when(F.col("name_") == k, F.col("v_"))).alias(k) for k in places])
    return sizes.join(picked, group)


def summary(df: DataFrame, value: str) -> DataFrame:
    """One row: mean, median, least, most, n_negative and n_positive of a column."""
    rows = df.select(F.lit(1).alias("all_"), F.col(value).cast("double").alias("x_"))
    middle = order_statistics(rows, "x_", {"low": F.ceil(F.col("n") / 2), "high": F.floor(F.col("n") / 2) + 1}, group=["all_"])
    ends = rows.groupBy("all_").agg(F.min("x_").alias("least"), F.max("x_").alias("most"), F.count_if(F.col("x_") < 0).alias("n_negative"), F.count_if(F.col("x_") > 0).alias("n_positive"))
    return middle.join(ends, "all_").select(F.round("mean", 6).alias("mean"), F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"), F.round("least", 6).alias("least"), F.round("most", 6).alias("most"), "n_negative", "n_positive")
