"""Count windows, drift and losses of live streams."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from trackloom.operators import windows
from trackloom.streaming import count_windows, events


def run(spark, live, tmp_path, rocks=True):
    with count_windows.rocks_state(spark):
        events.run_available(live, str(tmp_path / "out"), str(tmp_path / "c"))
    return spark.read.schema(live.schema).parquet(str(tmp_path / "out"))


def test_files_come_in_the_order_of_their_rows(spark, tmp_path):
    df = spark.range(100).select((F.lit(1000) - F.col("id")).alias("k")).repartition(7)
    events.in_arrival_order(df, ["k"], str(tmp_path / "in"), 4)
    seen = []
    stream = events.event_stream(spark, str(tmp_path / "in"), df.schema)
    q = stream.writeStream.foreachBatch(lambda b, _: seen.append(sorted(r.k for r in b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [x for batch in seen for x in batch] == list(range(901, 1001)) and [len(b) for b in seen] == [25] * 4


def test_live_windows_and_drift_equal_the_batch(spark, tmp_path):
    """One key's windows, with two features, against the operators over the whole table."""
    rng = random.Random(1)
    rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=k // 2), "x", rng.gauss(5, 1) + 9 * (k > 600), rng.random()) for k in range(1000)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, kind string, a double, b double")
    events.in_arrival_order(df, ["ts", "event_id"], str(tmp_path / "in"), 3)
    live = count_windows.live_windows(events.event_stream(spark, str(tmp_path / "in"), df.schema), "kind", "ts", "event_id", ["a", "b"], 30)
    got = {(r.win, r.feature): (r.n, r.first, r.last, r.mean, r.z) for r in run(spark, live, tmp_path).collect()}
    table = windows.count_windows(df, ["ts", "event_id"], ["a", "b"], 30)
    want = {(r.win, f): (r.n, r.first, r["last"], r[f], r.z) for f in ("a", "b") for r in windows.drift(table, f).where("n = 30").collect()}
    assert got.keys() == want.keys() and len(want) == 66
    for key, (n, first, last, mean, z) in want.items():
        assert got[key][:3] == (n, first, last) and abs(got[key][3] - mean) < 2e-4
        assert (z is None) == (got[key][4] is None or got[key][4] != got[key][4])
        assert z is None or abs(got[key][4] - z) < 0.05 * max(1, abs(z))
    assert any(abs(x[4] or 0) > 2.5 for x in want.values())


def test_a_silent_key_closes_its_window_by_a_timer(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(k, at + timedelta(minutes=k), "early", 1.0) for k in range(7)] + [(100 + k, at + timedelta(hours=k), "late", 2.0) for k in range(12)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, kind string, v double")
    events.in_arrival_order(df, ["ts", "event_id"], str(tmp_path / "in"), 4)
    live = count_windows.live_windows(events.event_stream(spark, str(tmp_path / "in"), df.schema), "kind", "ts", "event_id", ["v"], 5, patience="1 hour")
    found = defaultdict(list)
    for r in run(spark, live, tmp_path).collect():
        found[r.key].append((r.win, r.n))
    assert sorted(found["early"]) == [(0, 5), (1, 2)] and sorted(found["late"])[:2] == [(0, 5), (1, 5)]


def test_losses_are_counted_and_dropped(spark, tmp_path):
    days = [10, 11, 12, 30, 31, 32, 1, 40, 31, 2, 29, 41, 3, 35, 30]  # three a file; the mark is that of two files before, less five days
    df = spark.createDataFrame([(k, datetime(2024, 1, 1) + timedelta(days=d)) for k, d in enumerate(days)], "k long, ts timestamp")
    events.in_arrival_order(df, ["k"], str(tmp_path / "in"), 5)
    live = events.on_time(events.event_stream(spark, str(tmp_path / "in"), df.schema), "k", "ts", "5 days")
    with events.Losses(spark, "lost_rows") as losses:
        q = live.writeStream.queryName("lost_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        q.awaitTermination()
        told = {r.batch: (r.n, r.dropped, r.pct_dropped) for r in losses.table(q).collect()}
    late = {k for k, d in enumerate(days) if k >= 6 and d <= max(days[: (k // 3 - 1) * 3]) - 5}
    assert told == {b: (3, sum(k // 3 == b for k in late), round(100 * sum(k // 3 == b for k in late) / 3, 3)) for b in range(5)} and late
    assert {r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()} == set(range(15)) - late


class Kept:
    """A value of state in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value or []

    def update(self, value):
        self.value = value

    put = update


class Handle:
    def getValueState(self, *_):  # noqa: N802
        return Kept()

    getListState = getValueState  # noqa: N815


def test_windows_of_many_batches_equal_sums_one_by_one():
    """Batches that end within windows, or hold many of them; sums are added in the order of the events."""
    rng, rows, out = random.Random(2), [], []
    step = count_windows.CountWindows(["a"], 7, 3, 8, None)
    step.init(Handle())
    for n in (3, 1, 0, 24, 7, 100, 5):
        batch = [(len(rows) + k, round(rng.uniform(0, 1000), 2)) for k in range(n)]
        rows += batch
        df = pd.DataFrame({"key_": "x", "at": pd.Timestamp(0), "micros": [x[0] for x in batch], "turn": 0, "value0": [x[1] for x in batch]})
        out += list(step.handleInputRows(("x",), iter([df.sample(frac=1, random_state=1)]), None))
    got = [tuple(r) for r in pd.concat(out)[["win", "n", "first", "last", "mean"]].itertuples(index=False)]
    want = [rows[at : at + 7] for at in range(0, len(rows) - 6, 7)]
    micros = lambda k: pd.Timestamp(k, unit="us")
    assert got == [(w, 7, micros(x[0][0]), micros(x[-1][0]), round(sum(v for _, v in x) / 7, 4)) for w, x in enumerate(want)]
    assert step.open.get()[:2] == (20, 0)
