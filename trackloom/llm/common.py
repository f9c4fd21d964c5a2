"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shingle length in words and similarity from which two texts count as near copies.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Most bytes and rows that one Arrow batch may carry to a Python worker.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the vocabulary file of a public tokenizer lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes, so that long texts can't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a session on one machine may go without: it gets a
    folder of its own; elsewhere executors would write to disks that the others can't see."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df as written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Shelf:
    """Parquet tables of one job in the shared folder, which go when the job has no more use of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, f"job_{uuid.uuid4().hex}"
        self.folder, self.tables = f"{shared_folder(spark)}/{self.name}", []

    def put(self, df: DataFrame, bucket: tuple[int, str] | None = None) -> DataFrame:
        """df as written; with bucket, dealt by a column into so many files' groups, so that it is grouped by it without a shuffle."""
        at = f"{self.folder}/{len(self.tables)}"
        name = f"{self.name}_{len(self.tables)}"
        self.tables.append(name)
        if not bucket:
            df.write.parquet(at)
            return self.spark.read.schema(df.schema).parquet(at)
        df.write.format("parquet").bucketBy(*bucket).option("path", at).saveAsTable(name)
        return self.spark.table(name)

    def clear(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def finish(h: np.ndarray) -> np.ndarray:
    """Mix 64 bits well."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(factor: int, n: int) -> np.ndarray:
    """factor ** 0 .. factor ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Remembered(dict):
    """What a worker has worked out so far. When full, it takes nothing new until as many misses again show that the
    texts have changed, and then starts anew: frequent keys come early, so they are the ones that stay."""

    BOUND = 500_000
    #: Keys of more characters are not kept: texts without white space make keys of any length.
    LONGEST = 64

    def __init__(self):
        super().__init__()
        self.missed = 0

    def remember(self, key: str, value):
        if len(key) > self.LONGEST:
            return value
        if len(self) < self.BOUND:
            self[key] = value
        else:
            self.missed += 1
            if self.missed > 4 * self.BOUND:
                self.clear()
                self.missed = 0
        return value


class Words:
    """Words of a text (runs of letters and digits, whatever their case) as 64-bit hashes, found for all words at once.

    The hash of a word is a polynomial in its characters: a difference of running sums, moved back to the first place."""

    FACTOR = 0x9E3779B97F4A7C15
    #: Characters from here on are letters without case.
    PLAIN = 0x1FFFF

    def __init__(self):
        chars = [chr(c) for c in range(self.PLAIN)]
        self.inside = np.array([c.isalnum() for c in chars] + [True])
        self.lower = np.array([ord(low) if len(low := c.lower()) == 1 else ord(c) for c in chars] + [self.PLAIN], np.uint64)
        self.up = self.down = np.ones(0, np.uint64)

    def ready(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 4096)
            self.up, self.down = powers(self.FACTOR, n), powers(pow(self.FACTOR, -1, 1 << 64), n)

    def codes(self, text: str) -> np.ndarray:
        """Code points, those beyond PLAIN all as PLAIN."""
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return raw if not len(raw) or raw.max() < self.PLAIN else np.where(raw < self.PLAIN, raw, self.PLAIN)

    def of(self, text: str, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of each word."""
        codes = self.codes(text) if codes is None else codes
        edge = np.diff(self.inside[codes].view(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.ready(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self.lower[codes] * self.up[: len(codes)], out=sums[1:])
        return finish((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64)), start, end


def join_by_hot_keys(rows: DataFrame, table: DataFrame, keys: list[str], count: str, *, hot_keys: int = 1000, least: int = 10_000) -> DataFrame:
    """rows joined with a written table that has one row a key and `count`, how many of the rows hold it.

    All counts add up to the rows, so at most hot_keys keys hold more than a hot_keys-th of them: these are broadcast,
    and no task gets all rows of one. The other keys are joined by a shuffle."""
    many = max(least, (table.agg(F.sum(count)).first()[0] or 0) // hot_keys)
    hot, rest = (table.where(c).drop(count) for c in (F.col(count) > many, F.col(count) <= many))
    if not hot.limit(1).count():
        return rows.join(rest, keys)
    heads = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(heads, keys, "left_anti").join(rest, keys))
