"""Cleaning: casts that never fail, ranges, missing values, first rows of a key, samples of exact size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_number(name: str) -> Column:
    """The column as a double; text that is no number, and NaN, is null."""
    return F.expr(f"nanvl(try_cast(`{name}` AS DOUBLE), NULL)")


def as_year(name: str) -> Column:
    """The column as a whole year, read through a double and cut off: 1999.5 is 1999."""
    return F.expr(f"try_cast(try_cast(`{name}` AS DOUBLE) AS INT)")


def decade_of(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that df has, in the order asked for."""
    return df.select(*[c for c in columns if c in df.columns])


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in these columns."""
    return df.na.drop(subset=columns)


def first_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """For each key the row that comes first in the order. An aggregate: combined before the shuffle, so a key that
    holds much of the table costs no more than others."""
    rest = [c for c in df.columns if c != key]
    # rows that are ordered by all that they hold are not sent twice
    first = (F.min(F.struct(*rest)) if order == rest else F.min_by(F.struct(*rest), F.struct(*order))).alias("_first")
    return df.groupBy(key).agg(first).select(key, "_first.*").select(*df.columns)


def sample_exact(df: DataFrame, n: int, id_cols: list[str], seed: int = 42) -> DataFrame:
    """n rows that a seeded hash of their ids picks, the same in every run and on any number of machines."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed)))
    return df.withColumn("_h", F.md5(text.cast("binary"))).orderBy("_h", *id_cols).limit(n).drop("_h")


def sample_fraction(df: DataFrame, fraction: float, id_cols: list[str], seed: int = 42) -> DataFrame:
    """round(fraction * rows) rows; all of them for a fraction of 1 or more."""
    return df if fraction >= 1 else sample_exact(df, round(fraction * df.count()), id_cols, seed)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(value, high))


def clean_items(df: DataFrame, features: list[str], year_from: int, year_to: int, *, year_col: str = "year", id_col: str = "id", order: str | None = None) -> DataFrame:
    """Items of a closed range of years with all features as numbers, one row an id, and their decade.

    The first row of an id stays, by `order` where it is given, else by all columns. A table without years is an error."""
    if year_col not in df.columns:
        raise ValueError(f"the table has no column {year_col!r}")
    numbers = [as_number(c).alias(c) if c in features else as_year(c).alias(c) if c == year_col else F.col(c) for c in df.columns]
    out = df.select(*numbers).where(F.col(year_col).between(year_from, year_to))
    out = drop_missing(out, [c for c in features if c in out.columns])
    if id_col in out.columns:
        out = first_by_key(out, id_col, [order] if order else [c for c in out.columns if c != id_col])
    return out.withColumn("decade", decade_of(F.col(year_col)))
