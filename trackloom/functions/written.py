"""Tables that are written once in the middle of a job."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Tables that the innermost scratch deletes at its end.
_SCRATCH: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder. Only a session on one machine may go without spark.checkpoint.dir: elsewhere executors would
    write to disks that the others can't see."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder; cuts the plan of a loop and outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, *, stays: bool = False) -> DataFrame:
    """df written as Parquet in the shared checkpoint folder, for loops: what is read back has the size of its files.
    `kept` carries Spark's estimate of the size on, and a join's is the product of its sides', so that in a loop the
    digits of that number grow as a power of the rounds until they fill the driver. stays: no scratch deletes it."""
    at = f"{shared_folder(df.sparkSession)}/stored_{uuid.uuid4().hex}"
    df.write.parquet(at)
    back = df.sparkSession.read.schema(df.schema).parquet(at)
    if not stays and _SCRATCH.get() is not None:
        _SCRATCH.get().append(back)
    return back


def passing(df: DataFrame) -> DataFrame:
    """df written, for a step that comes soon: as Parquet, which takes less room, where a scratch deletes it, else kept."""
    return kept(df) if _SCRATCH.get() is None else stored(df)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored within goes at the end, and the shuffles behind it: Spark deletes their files when the driver
    collects what refers to them."""
    token = _SCRATCH.set([])
    try:
        yield
    finally:
        for table in _SCRATCH.get():
            forget(table)
        _SCRATCH.reset(token)
        spark.sparkContext._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        if path.getName().startswith("stored_"):
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
