"""Windows over a whole table in a total order, without moving all rows to one task.

The rows are dealt to ranges of the order, by all its columns, and written; the number of ranges follows the number of
rows. What each range adds up to is a row of a small table; the ranges before a row's own are summed up from it, and the
window runs within the range. Nulls come first, as in Spark's own ascending order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .written import passing

#: Rows of a range, about, and the least and most ranges that an order is cut into.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1_000_000, 8, 20_000


def with_range(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """df, written, with _range, the number of the range of its order that a row falls into, and _tie, by which rows that are
    equal in all columns of the order are told apart, so that many of them don't share one range."""
    ranges = ranges or min(MOST_RANGES, max(LEAST_RANGES, df.count() // RANGE_ROWS))
    return passing(df.withColumn("_tie", F.rand(7)).repartitionByRange(ranges, *order, "_tie").withColumn("_range", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[str], name: str = "rn", ranges: int | None = None) -> DataFrame:
    """df with each row's place in the total order, from 1 on."""
    dealt = with_range(df, order, ranges)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_tie"))
    return dealt.join(F.broadcast(before), "_range").withColumn(name, own + F.col("_before")).drop("_range", "_before", "_tie")


def running_max(df: DataFrame, order: list[str], value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """df with the largest value of all rows before a row in the total order; null for the first."""
    dealt = with_range(df.withColumn("_value", value), order, ranges)
    tops = dealt.groupBy("_range").agg(F.max("_value").alias("_m"))
    before = tops.select("_range", F.max("_m").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.max("_value").over(Window.partitionBy("_range").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.join(F.broadcast(before), "_range").withColumn(name, F.greatest(own, F.col("_before"))).drop("_range", "_before", "_value", "_tie")


def running_total(df: DataFrame, order: list[str], values: list[str], ranges: int | None = None) -> DataFrame:
    """df with total_<value>, the sum of all rows up to and with a row in the total order, for each of the values."""
    dealt = with_range(df, order, ranges)
    sums = dealt.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values])
    past = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_range", *[F.coalesce(F.sum(v).over(past), F.lit(0)).alias(f"_before_{v}") for v in values])
    own = Window.partitionBy("_range").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(F.broadcast(before), "_range")
    return joined.select(*df.columns, *[(F.sum(v).over(own) + F.col(f"_before_{v}")).alias(f"total_{v}") for v in values])
