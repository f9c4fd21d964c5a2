"""Reading and writing tables as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the item table that everything else defaults to.
META = ("id", "name", "artists", "year", "release_date")
FEATURES = ("danceability", "energy", "valence", "tempo", "acousticness", "instrumentalness", "loudness", "speechiness")
#: All as text: what can't be read as a number is dropped by cleaning, where it can be counted.
TRACK_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in (*META, *FEATURES)])


def scan_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table of a folder; only the named columns are read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, path: str, schema: T.StructType = TRACK_SCHEMA, *, keep_corrupt: bool = False) -> DataFrame:
    """A CSV file with a header, commas allowed within quotes. Lines that don't fit the schema are dropped, or kept
    with their text in _corrupt_record so that they can be counted."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    if keep_corrupt:
        return reader.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").csv(path)
    return reader.schema(schema).option("mode", "DROPMALFORMED").csv(path)


def newer_path(spark: SparkSession, csv_path: str) -> str:
    """The Parquet copy beside a CSV file if there is one that isn't older, else the CSV file. Any file system of Spark's."""
    jvm = spark.sparkContext._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in (csv_path.rsplit(".", 1)[0] + ".parquet", csv_path)]
    fs = paths[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(paths[0]):
        return csv_path
    if not fs.exists(paths[1]):
        return str(paths[0])
    times = [fs.getFileStatus(p).getModificationTime() for p in paths]
    return str(paths[0]) if times[0] >= times[1] else csv_path


def load(spark: SparkSession, csv_path: str, schema: T.StructType = TRACK_SCHEMA) -> DataFrame:
    """The Parquet copy of a CSV file if it is up to date, else the CSV file."""
    path = newer_path(spark, csv_path)
    return spark.read.parquet(path) if path.endswith(".parquet") else scan_csv(spark, path, schema)


def cache_as_parquet(df: DataFrame, csv_path: str) -> str:
    """Write df as the Parquet copy of a CSV file."""
    path = csv_path.rsplit(".", 1)[0] + ".parquet"
    df.write.mode("overwrite").parquet(path)
    return path


def kept_result(df: DataFrame, source: str, cache: str, version: str = "1") -> DataFrame:
    """df, a small result of the file or folder `source`, read from `cache` if one of the same version, name, size and time
    of the source was kept there, else computed and kept."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    fs = at.getFileSystem(hadoop)
    state = fs.getFileStatus(at)
    kept = f"{cache}/{version}-{at.getName()}-{fs.getContentSummary(at).getLength()}-{state.getModificationTime()}.parquet"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{kept}/_SUCCESS")
    if not where.getFileSystem(hadoop).exists(where):
        df.write.mode("overwrite").parquet(kept)
    return spark.read.schema(df.schema).parquet(kept)


def save_items(df: DataFrame, path: str, *, by: str = "decade", columns: list[str] | None = None) -> None:
    """Write items partitioned by a column, so that a search for one value reads only its files."""
    (df.select(*columns) if columns else df).write.mode("overwrite").partitionBy(by).parquet(path)


def finite(c: Column) -> Column:
    """c, or null where it is NaN or infinite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def has_reals(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_reals(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return has_reals(kind.elementType)
    return has_reals(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, (T.DoubleType, T.FloatType))


def finite_within(c: Column, kind: T.DataType) -> Column:
    """c with null for every NaN and infinite number at any depth of structs, lists and values of maps."""
    if not has_reals(kind):
        return c
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[finite_within(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: finite_within(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: finite_within(x, kind.valueType))
    return finite(c)


def to_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text in the column json; NaN and infinite numbers are null, however deep they lie."""
    clean = [finite_within(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))


def read_items(spark: SparkSession, path: str, *, by: str = "decade", values: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """Items of a partitioned store whose partition is among the values (a table with the column `by`): the values are
    found first, and only their folders are read. Without values, all."""
    items = spark.read.parquet(path)
    items = items.select(*dict.fromkeys([*columns, by])) if columns else items
    # a broadcast of at most as many rows as there are folders: Spark prunes by what it holds
    return items if values is None else items.join(F.broadcast(values.select(by).distinct()), by)
