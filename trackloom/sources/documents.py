"""A folder of JSON documents as a small store: append, find, change, drop. Changes write a new version of the folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def open_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc): the documents of a folder of JSON lines as VARIANT, whatever their shapes; a line that isn't JSON is null."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("doc"))


def append_open(df: DataFrame, doc: str, path: str) -> None:
    """Add VARIANT documents to such a folder."""
    df.where(F.col(doc).isNotNull()).select(F.to_json(doc)).write.mode("append").text(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def find(spark: SparkSession, path: str, schema: T.StructType, where: Column | None = None, *, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Documents that match, newest first where an order is given: its columns descending."""
    df = spark.read.schema(schema).json(path)
    df = df if where is None else df.where(where)
    df = df.orderBy(*[F.desc(c) for c in order]) if order else df
    return df if limit is None else df.limit(limit)


def change(spark: SparkSession, path: str, new_path: str, schema: T.StructType, where: Column, values: dict[str, Column]) -> None:
    """Write the documents with the values set where the condition holds."""
    df = spark.read.schema(schema).json(path)
    hit = F.coalesce(where, F.lit(False))
    df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns]).write.json(new_path)


def drop(spark: SparkSession, path: str, new_path: str, schema: T.StructType, where: Column) -> None:
    """Write the documents for which the condition doesn't hold."""
    spark.read.schema(schema).json(path).where(~F.coalesce(where, F.lit(False))).write.json(new_path)
