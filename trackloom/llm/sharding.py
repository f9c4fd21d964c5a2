"""Shuffled shards by a two-pass external shuffle, in DataFrame functions alone.

First pass: seeded hashes scatter the records uniformly over shards and, within each, over buckets of bounded size.
Second pass: each bucket is shuffled in memory (Spark's shuffle() is a Fisher-Yates shuffle) and laid out behind the
buckets before it. Spark seeds that by the number of the partition, so the partitions of this pass are as many as the
data ask for, whatever the cluster's settings, and their records are put in order first. The shard is the one whose seeded hash with the record's key is highest, so that a further shard
takes records only into itself. The bucket is a hash of the key too, unless a key's records are too many for one: these
are dealt over the buckets of their shard by key and text, and equal texts of a key by a number of the record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SHARDS = 16
#: Partitions of the second pass, at most; beyond it, buckets share one and are filled one after the other.
MOST_PARTITIONS = 20_000
SEED = 20_231
#: Bytes of text in a bucket, on average; a bucket is one task's unit of work.
BUCKET_BYTES = 8 << 20
#: Buckets' worth of bytes from which one key, or one text of a key, is dealt over all buckets of its shard, and the bytes
#: that a record takes besides its text.
HOT_BUCKETS, RECORD_BYTES = 4, 64


def highest(key: str, n: int, seed: int):
    """The shard from 0 to n - 1 whose hash with the key is highest."""
    return F.array_max(F.array(*[F.struct(F.xxhash64(F.col(key), F.lit(k), F.lit(seed)).alias("h"), F.lit(k).alias("k")) for k in range(n)])).getField("k")


def spread(rows: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """rows with _salt: null where the key's bucket can hold the key's records, else what the record is dealt by."""
    weight = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + RECORD_BYTES

    def heavy(keyed: DataFrame) -> DataFrame | None:
        # all bytes add up to the table's, so those over the limit are at most the table's buckets in number
        many = checkpointed(keyed.groupBy("_key").agg(F.sum(weight).alias("_bytes")).where(F.col("_bytes") > limit).select("_key"))
        return F.broadcast(many) if many.limit(1).count() else None

    by_id = rows.withColumn("_key", F.xxhash64(id_col, F.lit(0)))
    hot = heavy(by_id)
    if hot is None:
        return rows.withColumn("_salt", F.lit(None).cast("long"))
    cold = by_id.join(hot, "_key", "left_anti").drop("_key").withColumn("_salt", F.lit(None).cast("long"))
    by_text = by_id.join(hot, "_key", "left_semi").withColumn("_key", F.xxhash64(id_col, text_col, F.lit(0)))
    same = heavy(by_text)
    if same is None:
        return cold.unionByName(by_text.withColumnRenamed("_key", "_salt"))
    # numbers of records are settled once, as buckets are counted in one pass and filled in another
    numbered = checkpointed(by_text.join(same, "_key", "left_semi").withColumn("_salt", F.xxhash64("_key", F.monotonically_increasing_id())).drop("_key"))
    return cold.unionByName(by_text.join(same, "_key", "left_anti").withColumnRenamed("_key", "_salt")).unionByName(numbered)


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs' columns with size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: the id and the number of shards decide. slot is the record's place in its shard, gapless from 0, and
    the same in every run over the same rows, on any number of machines.
    Records of a key that is too large for a bucket share its shard, but not a bucket.
    A null text has size 1 and the CRC of no bytes; a null id is a key like any other; rows of equal id share a shard.
    An empty table gives no rows. Columns of docs with those names give way."""
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    own = [c for c in docs.columns if c not in made]
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1)).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))

    def dealt(df: DataFrame) -> DataFrame:
        by = F.when(F.col("_salt").isNull(), F.xxhash64(id_col, F.lit(seed + 1))).otherwise(F.xxhash64("_salt", F.lit(seed + 1)))
        return df.withColumn("_shard", highest(id_col, shards, seed)).withColumn("_bucket", F.pmod(by, F.lit(buckets)).cast("long")).drop("_salt")

    rows = spread(docs.select(*own), id_col, text_col, HOT_BUCKETS * bucket_bytes)
    sizes = dealt(rows.select(id_col, "_salt")).groupBy("_shard", "_bucket").count()
    before = sizes.select("_shard", "_bucket", (F.sum("count").over(Window.partitionBy("_shard").orderBy("_bucket")) - F.col("count")).alias("_before"))
    records = F.array_sort(F.collect_list(F.struct(id_col, *[c for c in own if c != id_col])))
    placed = dealt(rows).repartition(min(shards * buckets, MOST_PARTITIONS), "_shard", "_bucket")
    filled = placed.groupBy("_shard", "_bucket").agg(records.alias("_records")).sortWithinPartitions("_shard", "_bucket")
    mixed = filled.select("_shard", "_bucket", F.shuffle("_records", F.lit(seed)).alias("_records"))
    laid = mixed.join(before, ["_shard", "_bucket"]).select("_shard", "_before", F.posexplode("_records").alias("_place", "_record"))
    out = laid.select("_shard", "_before", "_place", "_record.*")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return out.select(
        *own,
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_before") + F.col("_place")).cast("long").alias("slot"),
        highest(id_col, shards + 1, seed).alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shuffled records as Parquet, a folder for each shard; slot gives their order.

    Slots are settled once, as a task that ran anew could deal other slots than those that have been read already."""
    out = checkpointed(shard(docs, **options))
    out.repartition("shard", F.floor(F.col("slot") / 50_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
