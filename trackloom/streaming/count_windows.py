"""Count windows and drift on a live stream: state by key, in arrival order."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import HISTORY

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "key string, win long, n long, first timestamp, last timestamp, feature string, mean double, z double"

# the process in which Spark sets a stream up knows no paths but its own: what this module defines is sent whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class CountWindows(StatefulProcessor):
    """Windows of `size` events of a key. State is the open window (counts and sums), the means of the last few windows and
    the last `history` steps of their rolling mean, whatever the stream's length. With patience, a timer closes a window
    that has had no event for so many milliseconds of event time, however short it is."""

    def __init__(self, features: list[str], size: int, over: int, history: int, patience: int | None):
        self.features, self.size, self.over, self.history, self.patience = features, size, over, history, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "win long, n long, first long, last long, sums array<double>")
        self.means = handle.getListState("means", "v array<double>")
        self.steps = handle.getListState("steps", "v array<double>")

    def closed(self, key: str, win: int, n: int, first: int, last: int, sums: list[float]) -> list[tuple]:
        """The rows of a window, and its mean and step remembered."""
        now = [round(x / n, 4) for x in sums]
        past, steps = [list(r[0]) for r in self.means.get()], [list(r[0]) for r in self.steps.get()]
        out = []
        rolling = lambda rows, f: math.fsum(r[f] for r in rows[-self.over :]) / len(rows[-self.over :])
        step = [rolling([*past, now], f) - rolling(past, f) for f in range(len(now))] if past else None
        for f, name in enumerate(self.features):
            z = None
            if len(steps) >= self.history and len(steps) >= 3:
                mean = math.fsum(s[f] for s in steps) / len(steps)
                sd = math.sqrt(math.fsum((s[f] - mean) ** 2 for s in steps) / len(steps))
                z = (step[f] - mean) / sd if sd > 1e-9 else None
            out.append((key, win, n, first, last, name, now[f], z))
        self.means.put([(r,) for r in [*past, now][-self.over :]])
        if step is not None:
            self.steps.put([(r,) for r in [*steps, step][-self.history :]])
        return out

    @staticmethod
    def table(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["key", "win", "n", "first", "last", "feature", "mean", "z"])
        for c in ("first", "last"):
            out[c] = pd.to_datetime(out[c], unit="us")
        return out.astype({"win": "int64", "n": "int64", "mean": "float64", "z": "float64"})

    def timer(self, last: int) -> None:
        if self.patience is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(last // 1000 + self.patience)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        every = pd.concat(list(rows)).sort_values(["micros", "turn"], kind="stable")  # of one batch of the stream
        win, n, first, last, sums = self.open.get() if self.open.exists() else (0, 0, 0, 0, [0.0] * len(self.features))
        sums, out = list(sums), []
        micros, values = every["micros"].to_numpy(), every[[f"value{k}" for k in range(len(self.features))]].to_numpy(dtype=float)
        at = 0
        while at < len(micros):  # a window, or what there is of it, at a time
            to = min(at + self.size - n, len(micros))
            first = int(micros[at]) if not n else min(first, int(micros[at]))
            last = int(micros[to - 1]) if not n else max(last, int(micros[to - 1]))
            sums = np.cumsum(np.vstack([sums, values[at:to]]), axis=0)[-1].tolist()  # one after the other, as events come
            n, at = n + to - at, to
            if n == self.size:
                out += self.closed(str(key[0]), win, n, first, last, sums)
                win, n, sums = win + 1, 0, [0.0] * len(self.features)
        self.open.update((win, n, first, last, sums))
        if n:
            self.timer(int(last))
        yield self.table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        win, n, first, last, sums = self.open.get()
        if not n:
            yield self.table([])
            return
        out = self.closed(str(key[0]), win, n, first, last, list(sums))
        self.open.update((win + 1, 0, 0, 0, [0.0] * len(self.features)))
        yield self.table(out)

    def close(self) -> None:
        pass


def live_windows(stream: DataFrame, key: str, ts: str, order: str, features: list[str], size: int, *, over: int = 3, history: int = HISTORY, patience: str | None = None, lag: str = "0 seconds") -> DataFrame:
    """(key, win, n, first, last, feature, mean, z): a row for each feature of each window as it fills; z is the distance of
    the step of the rolling mean from the `history` steps before it, in their standard deviations.

    Events of a batch count in the order of their times (then of `order`), batches as they come. patience: short windows
    are closed when the watermark is so far past their last event; the stream then drops events later than the lag."""
    rows = stream.select(F.col(key).cast("string").alias("key_"), F.col(ts).cast("timestamp").alias("at"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"), F.col(order).alias("turn"), *[F.col(f).cast("double").alias(f"value{k}") for k, f in enumerate(features)])
    wait = None
    if patience is not None:
        rows = rows.withWatermark("at", lag)
        wait = int(pd.Timedelta(patience).total_seconds() * 1000)
    step = CountWindows(features, size, over, history, wait)
    return rows.groupBy("key_").transformWithStateInPandas(step, SCHEMA, "append", "none" if patience is None else "eventTime")


class rocks_state:  # noqa: N801
    """While it lasts, streams that start keep their state in RocksDB, which this kind of state needs."""

    NAME = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(self.NAME, None)
        self.spark.conf.set(self.NAME, ROCKS)

    def __exit__(self, *_):
        if self.before is None:
            self.spark.conf.unset(self.NAME)
        else:
            self.spark.conf.set(self.NAME, self.before)
