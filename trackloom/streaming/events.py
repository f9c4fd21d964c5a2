"""Event-time windows and late events on live streams."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.ordering import numbered
from ..functions.written import kept

#: The features that a stream follows.
STREAM_FEATURES = ["energy", "acousticness", "valence", "danceability"]


def pick_features(features: list[str]) -> list[str]:
    """The features of STREAM_FEATURES that are there, else the first three."""
    return [f for f in STREAM_FEATURES if f in features] or features[:3]


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, in batches of so many files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def in_arrival_order(df: DataFrame, order: list[str], path: str, parts: int) -> None:
    """Write df to a folder as so many files, one after the other, in a total order of its rows: a stream that takes a file
    at a time then sees them in that order."""
    placed = numbered(df, order, "_place")
    total = F.broadcast(placed.agg(F.count("*").alias("_n")))
    dealt = kept(placed.join(total, F.lit(True)).withColumn("_part", F.expr(f"(_place - 1) * {parts} div _n")))
    for part in range(parts):
        dealt.where(F.col("_part") == part).select(*df.columns).coalesce(1).write.mode("append").parquet(path)


def on_time(events: DataFrame, id_col: str, ts: str, lag: str) -> DataFrame:
    """The events of a stream that come no later than the lag behind the latest, each id once within it. What is later is
    dropped here, row by row, so that it can be counted."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lag)
    return timed.dropDuplicatesWithinWatermark([id_col]).drop("_ts")


class Losses(StreamingQueryListener):
    """While it lasts, what each batch of a named stream took in and dropped as too late. Spark tells of a batch when it is
    done; table() waits for the last one of a query that has ended."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.seen = spark, name, {}

    def __enter__(self) -> Losses:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name == self.name:
            dropped = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            self.seen[p.batchId] = (p.batchId, p.numInputRows, dropped, float(p.processedRowsPerSecond or 0.0), (p.eventTime or {}).get("watermark"))

    def table(self, query: StreamingQuery, patience: float = 30.0) -> DataFrame:
        """(batch, n, dropped, pct_dropped, rows_per_second, watermark): a row for each batch that took in rows."""
        last, until = query.lastProgress, time.monotonic() + patience
        while last is not None and last["batchId"] not in self.seen and time.monotonic() < until:
            time.sleep(0.05)
        rows = self.spark.createDataFrame(sorted(x for x in self.seen.values() if x[1]), "batch long, n long, dropped long, rows_per_second double, watermark string")
        return rows.withColumn("pct_dropped", F.round(100.0 * F.col("dropped") / F.col("n"), 3))


def windowed_counts(events: DataFrame, *, ts: str = "ts", keys: tuple[str, ...] = ("event_type",), value: str = "value", length: str = "1 day", lag: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and keys; the same query on a stream, with a watermark, and on a table."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_ts", lag)
    w = F.window("_ts", length, slide) if slide else F.window("_ts", length)
    out = timed.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now into Parquet, and end."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()


def late_by_key(events: DataFrame, key: str, *, ts: str = "ts") -> DataFrame:
    """For each batch and key, how many events came so far, and how many of them after a later one. State is two numbers
    a key, so the stream can run for ever; events of a batch count in event-time order of arrival."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, late, latest = state.get if state.exists else (0, 0, -(1 << 62))
        for part in parts:
            for micros in part["_micros"]:
                seen, late, latest = seen + 1, late + (micros < latest), max(latest, int(micros))
        state.update((seen, late, latest))
        yield pd.DataFrame({"key": [str(k[0])], "n": [seen], "n_late": [late]})

    rows = events.select(F.col(key).cast("string").alias("_key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_micros"))
    return rows.groupBy("_key").applyInPandasWithState(step, "key string, n long, n_late long", "n long, n_late long, latest long", "update", GroupStateTimeout.NoTimeout)
