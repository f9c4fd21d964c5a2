"""Counts, shares, profiles, joins, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most rows of a join's small side that are broadcast; a larger side is joined by a shuffle.
BROADCAST_ROWS = 100_000


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most that many rows. No more than that are counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def count_by(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def pivot_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """A row for each value of `row`, a count column for each of the given values of `column`; missing cells are 0."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(str(v)) for v in values])


def rollup_counts(df: DataFrame, keys: list[str], total: str = "(all)") -> DataFrame:
    """Counts by all keys, by fewer and fewer of them, and of the whole; a total stands where a key is summed up."""
    out = df.rollup(*keys).agg(F.count("*").alias("n"), *[F.grouping(k).alias(f"_g_{k}") for k in keys])
    return out.select(*[F.when(F.col(f"_g_{k}") == 1, total).otherwise(F.col(k).cast("string")).alias(k) for k in keys], "n")


def row_shares(df: DataFrame, row: str, values: list[str]) -> DataFrame:
    """Counts of a pivot as per cent of their row, two decimals, with the row's total."""
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return df.select(row, total.alias("total"), *[F.round(100.0 * F.col(v) / total, 2).alias(v) for v in values])


def with_share(counts: DataFrame, n: str = "n") -> DataFrame:
    """Grouped counts with their per cent of the whole, which is a broadcast sum of them."""
    return counts.join(F.broadcast(counts.agg(F.sum(n).alias("_all"))), F.lit(True)).withColumn("share_pct", F.round(100.0 * F.col(n) / F.col("_all"), 2)).drop("_all")


def profile(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Size, per cent of all rows and feature means of each group, in one pass."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in features])
    return with_share(sizes)


def trend(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, feature, mean): the mean of each feature in each group, in one pass."""
    wide = df.groupBy(key).agg(*[F.round(F.avg(c), 4).alias(c) for c in features])
    return wide.unpivot([key], features, "feature", "mean")


def trend_rows(long: DataFrame, key: str, features: list[str]) -> DataFrame:
    """The rows of `trend` as one row a group, a column for each feature."""
    return long.groupBy(key).agg(*[F.max(F.when(F.col("feature") == f, F.col("mean"))).alias(f) for f in features])


def mode_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equals, and its per cent of the group."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct("n", (-F.col(value)).alias("o"))).alias("top"), F.sum("n").alias("size"))
    return best.select(key, "size", F.col(f"top.{value}").alias("mode"), F.round(100.0 * F.col("top.n") / F.col("size"), 2).alias("mode_pct"))


def histogram(df: DataFrame, column: str, width: int) -> DataFrame:
    """Bins of equal width from 0 to the largest value; the last is closed on the right; empty bins are 0."""
    bins = df.agg(F.greatest(F.ceil(F.max(column) / width), F.lit(1)).cast("long").alias("bins"))
    counts = df.join(F.broadcast(bins), F.lit(True)).groupBy(F.least(F.floor(F.col(column) / width), F.col("bins") - 1).alias("bin")).agg(F.count("*").alias("n"))
    grid = bins.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", (F.col("bin") * width).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def lookup_join(df: DataFrame, table: DataFrame, key: str, value: str, *, default: Column | None = None) -> DataFrame:
    """df with a value from a small table; rows without one are dropped, or take the default where it is given."""
    small = checked_broadcast(table.select(key, value))
    if default is None:
        return df.join(small, key)
    return df.join(small, key, "left").withColumn(value, F.coalesce(F.col(value), default))


def missing_from(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows of df whose key is nowhere in other."""
    return df.join(other.select(F.col(other_key).alias(key)), key, "left_anti")


def overlay(stored: DataFrame, live: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both by key, the live one where both have it, with their origin."""
    s, l = stored.select(key, F.struct(*columns).alias("_s")), live.select(key, F.struct(*columns).alias("_l"))  # noqa: E741
    both = s.join(l, key, "full_outer").withColumn("_row", F.coalesce("_l", "_s"))
    return both.select(key, *[F.col(f"_row.{c}").alias(c) for c in columns], F.when(F.col("_l").isNotNull(), "live").otherwise("stored").alias("origin"))


def top_n(df: DataFrame, by: str, n: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(n)


def page(df: DataFrame, order: list[str], number: int = 1, size: int = 50) -> DataFrame:
    """One page of a total order. The number is from 1 on, the size from 1 to 200."""
    if number < 1 or not 1 <= size <= 200:
        raise ValueError("page numbers start at 1, pages hold 1 to 200 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_with_total(df: DataFrame, order: list[str], number: int = 1, size: int = 50) -> DataFrame:
    """One page of a total order, with total, the number of all rows, beside each of its rows."""
    return page(df, order, number, size).join(F.broadcast(df.agg(F.count("*").alias("total"))), F.lit(True))


def search(df: DataFrame, needle: str, columns: list[str], *, regex: bool = False) -> DataFrame:
    """Rows where one of the columns holds the needle, whatever the case: as plain text, or as a regex."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).rlike(f"(?i){needle}") if regex else F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))
    return df.where(hit)


def label_rules(mean: dict[str, Column]) -> Column:
    """A group's label from its feature means; the first rule that holds decides."""
    value = lambda name, other=0.0: F.coalesce(mean[name], F.lit(other)) if name in mean else F.lit(other)
    instrumental, acoustic, energy, dance, valence, speech = map(value, ("instrumentalness", "acousticness", "energy", "danceability", "valence", "speechiness"))
    loud = value("loudness", -10.0)
    # Thresholds and names
    rules = [
        (instrumental >= 0.50, "Instrumental / Ambient"),
        (speech >= 0.15, "Spoken / Lyrical"),
        ((acoustic >= 0.55) & (energy <= 0.50), "Acoustic / Organic"),
        ((energy >= 0.75) & (acoustic <= 0.20), "High-Energy Electronic"),
        ((dance >= 0.60) & (valence >= 0.60), "Bright / Upbeat"),
        (dance >= 0.60, "Rhythmic / Dance"),
        ((energy >= 0.68) & (acoustic <= 0.30), "High-Energy Electronic"),
        ((energy >= 0.70) & (loud >= -6.0), "Loud / Intense"),
        ((energy <= 0.40) & (valence <= 0.45), "Mellow / Low-Energy"),
    ]
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out.otherwise("Vocal / Pop")


def tell_apart(groups: DataFrame, label: str, key: str) -> DataFrame:
    """Labels of a few groups, made unique: from the second of a name on, the group's id follows."""
    nth = F.row_number().over(Window.partitionBy(label).orderBy(key))
    return groups.withColumn(label, F.when(nth > 1, F.concat(F.col(label), F.lit(" (C"), F.col(key).cast("string"), F.lit(")"))).otherwise(F.col(label)))
