"""Operators against small tables worked out by hand, and the properties that SQL can't show."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackloom.functions.ordering import numbered, running_max, running_total
from trackloom.functions.quantiles import quantiles
from trackloom.functions.text import code_points, credits, human_size, tokens
from trackloom.functions.written import scratch, stored
from trackloom.operators import clean, docs, graph, ml, relational, stats, windows
from trackloom.plans import pipeline
from trackloom.sources import documents, files
from trackloom.streaming import events

FEATURES = ["danceability", "energy", "valence", "tempo", "acousticness", "instrumentalness", "loudness", "speechiness"]


def tracks(n=400, seed=7):
    """Rows whose acousticness falls with the years and whose energy grows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        year = rng.randint(1960, 2023)
        a = min(max(1 - (year - 1960) / 70, 0.05), 0.95)
        cut = lambda x: min(max(x, 0.0), 1.0)
        rows.append((f"t{i}", f"Track {i}", f"['Artist {i % 23}']", f"{year}.0", "2000-01-01", *map(str, (rng.random(), cut(1 - a + rng.gauss(0, 0.1)), rng.random(), rng.uniform(60, 200), cut(a + rng.gauss(0, 0.1)), rng.random(), rng.uniform(-60, 0), rng.random()))))
    return rows


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(tracks(), files.TRACK_SCHEMA)


# --- reading and cleaning

def test_csv_keeps_commas_in_quotes_and_survives_bad_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,artists,year\n1,"One, two",A,1967\n2,b,"[\'A\', \'B\']",1991\n3,c,C,2001\n4,"open,D\n')
    schema = files.T.StructType([files.T.StructField(c, files.T.StringType()) for c in ("id", "name", "artists", "year")])
    rows = {r.id: r for r in files.scan_csv(spark, str(tmp_path / "a.csv"), schema).collect()}
    assert rows["1"].name == "One, two" and rows["2"].artists == "['A', 'B']" and rows["3"].year == "2001"
    kept = files.scan_csv(spark, str(tmp_path / "a.csv"), schema, keep_corrupt=True).cache()
    assert kept.where("_corrupt_record IS NOT NULL").count() >= 1


def test_parquet_copy_is_read_if_newer(spark, raw, tmp_path):
    path = str(tmp_path / "t.csv")
    raw.limit(20).toPandas().to_csv(path, index=False)
    assert files.load(spark, path).count() == 20
    files.cache_as_parquet(raw.limit(7), path)
    assert files.newer_path(spark, path).endswith(".parquet") and files.load(spark, path).count() == 7


def test_json_has_no_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "id int, x double")
    assert [r.json for r in files.to_json(df).orderBy("json").collect()] == ['{"id":1,"x":null}', '{"id":2,"x":null}', '{"id":3,"x":1.5}']


def test_saved_items_are_pruned_by_partition(spark, raw, tmp_path):
    items = clean.clean_items(raw, FEATURES, 1960, 2023)
    files.save_items(items, str(tmp_path / "items"), columns=["id", "name", "year", "decade"])
    plan = spark.read.parquet(str(tmp_path / "items")).where("decade = 1980")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(decade" in plan


def test_decimal_years_are_read(raw):
    assert clean.clean_items(raw, FEATURES, 1960, 2023).count() == 400


def test_malformed_rows_go(spark, raw):
    bad = raw.withColumn("energy", F.when(F.col("id") == "t0", "not-a-number").otherwise(F.col("energy"))).withColumn("year", F.when(F.col("id") == "t1", "garbage").otherwise(F.col("year")))
    assert clean.clean_items(bad, FEATURES, 1960, 2023).count() == 398


def test_year_window_and_missing_year(raw):
    decades = {r.decade for r in clean.clean_items(raw, FEATURES, 1980, 1999).select("decade").distinct().collect()}
    assert decades <= {1980, 1990}
    with pytest.raises(ValueError, match="year"):
        clean.clean_items(raw.drop("year"), FEATURES, 1960, 2023)


def test_negative_years_floor(spark):
    df = spark.createDataFrame([(-5,), (5,), (1999,)], "y int")
    assert [r[0] for r in df.select(clean.decade_of(F.col("y"))).collect()] == [-10, 0, 1990]


def test_first_of_a_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 9, None)], "k string, o int, v string")
    assert sorted(map(tuple, clean.first_by_key(df, "k", ["o"]).collect())) == [("a", 1, "y"), ("b", 9, None)]


def test_samples_repeat_and_have_their_size(raw):
    one, two = ({r.id for r in clean.sample_exact(df, 37, ["id"]).collect()} for df in (raw, raw.repartition(7)))
    assert one == two and len(one) == 37 and clean.sample_fraction(raw, 0.1, ["id"]).count() == 40


# --- order over the whole table

@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(0, 9)), min_size=1, max_size=80))
def test_numbers_and_running_max(spark, pairs):
    rows = [(k, a, b) for k, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "k int, a int, b int").repartition(3)
    want = {k: n for n, (k, a, b) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    assert {r.k: r.rn for r in numbered(df, ["a", "k"], ranges=4).collect()} == want
    top, best = {}, None
    for k, a, b in rows:
        top[k] = best
        best = b if best is None else max(best, b)
    assert {r.k: r.top for r in running_max(df, ["k"], F.col("b"), "top", ranges=4).collect()} == top


def test_null_order_keys_come_first_and_stay(spark):
    from trackloom.operators import windows

    rows = [(k, None if k % 4 == 0 else k % 5, float(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, a int, v double").repartition(3)
    got = {r.k: r.rn for r in numbered(df, ["a", "k"]).collect()}
    assert got == {k: n for n, (k, _, _) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])), 1)}
    assert running_max(df, ["a", "k"], F.col("v"), "top").count() == 40
    assert {r.k: r.total_v for r in running_total(df, ["a", "k"], ["v"]).collect()}.keys() == {k for k, _, _ in rows}
    assert windows.late_events(df, "a", "v").count() == 40
    assert windows.count_windows(df, ["a", "k"], ["v"], 7).agg(F.sum("n")).first()[0] == 40


def test_ties_in_the_first_column_are_cut_by_the_others(spark):
    from trackloom.functions.ordering import with_range

    df = spark.range(4000).select(F.lit(1).alias("day"), "id")
    sizes = [r["count"] for r in with_range(df, ["day", "id"], 8).groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500


def test_time_order(spark):
    df = spark.sql("SELECT id, timestamp_ntz '2024-01-01' + make_dt_interval(0, cast(pmod(id * 37, 50) as int)) AS ts FROM range(200)")
    rows = {r.id: r.rn for r in numbered(df, ["ts", "id"], ranges=8).collect()}
    assert [k for k, _ in sorted(rows.items(), key=lambda x: x[1])] == sorted(range(200), key=lambda k: (k * 37 % 50, k))


# --- text

def test_tokens_and_credits(spark):
    df = spark.createDataFrame([("The Song of DON'T stop, ab abc", "['A', \"B\"; none,, C ]"), (None, None)], "t string, c string")
    a, b = df.select(tokens(F.col("t")).alias("t"), credits(F.col("c")).alias("c")).collect()
    assert a.t == ["don't", "stop", "abc"] and a.c == ["A", "B", "C"] and b.t == [] and b.c == []


def test_sizes_and_codes(spark):
    df = spark.createDataFrame([(0, "key"), (1023, "é"), (1024, "b"), (5 << 20, "c"), (3 << 40, "d")], "n long, k string")
    rows = df.select(human_size(F.col("n")).alias("h"), code_points(F.col("k")).alias("c")).collect()
    assert [r.h for r in rows] == ["0B", "1023B", "1.0K", "5.0M", "3.0T"]
    assert rows[0].c == [107, 101, 121]


# --- labels, paging, joins

CASES = [
    ({"instrumentalness": 0.6, "speechiness": 0.9}, "Instrumental / Ambient"), ({"speechiness": 0.2}, "Spoken / Lyrical"), ({"acousticness": 0.6, "energy": 0.4}, "Acoustic / Organic"),
    ({"energy": 0.8, "acousticness": 0.1}, "High-Energy Electronic"), ({"danceability": 0.7, "valence": 0.7}, "Bright / Upbeat"), ({"danceability": 0.7, "valence": 0.1}, "Rhythmic / Dance"),
    ({"energy": 0.7, "acousticness": 0.5, "loudness": -5.0}, "Loud / Intense"), ({"energy": 0.3, "valence": 0.3}, "Mellow / Low-Energy"), ({"energy": 0.5, "valence": 0.9}, "Vocal / Pop"),
]


def test_label_rules(spark):
    for means, want in CASES:
        assert spark.range(1).select(relational.label_rules({k: F.lit(v) for k, v in means.items()})).first()[0] == want


def test_labels_are_told_apart(spark):
    df = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "cluster int, label string")
    assert [r.label for r in relational.tell_apart(df, "label", "cluster").orderBy("cluster").collect()] == ["x", "y", "x (C2)"]


def test_pages_have_bounds(spark):
    df = spark.range(120)
    assert [r.id for r in relational.page(df, ["id"], 3, 50).collect()] == list(range(100, 120))
    for number, size in ((0, 50), (1, 0), (1, 201)):
        with pytest.raises(ValueError):
            relational.page(df, ["id"], number, size)


def test_search_is_literal_unless_regex(spark):
    df = spark.createDataFrame([("A (b)", None), ("xx", "C+")], "a string, b string")
    assert relational.search(df, "(B", ["a", "b"]).count() == 1 and relational.search(df, "c.", ["a", "b"], regex=True).count() == 1


def test_small_sides_alone_are_broadcast(spark):
    big, small = spark.range(1000), spark.range(10)
    plan = lambda rows: big.join(relational.checked_broadcast(small, rows), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(10) and "strategy=broadcast" not in plan(9)


# --- statistics and windows

def test_scaling(raw):
    items = clean.clean_items(raw, FEATURES, 1960, 2023)
    z = ml.standardize(items.withColumn("flat", F.lit(3.0)), ["energy", "flat"])
    got = z.agg(F.avg("energy"), F.stddev_pop("energy"), F.max(F.abs("flat"))).first()
    assert abs(got[0]) < 1e-9 and abs(got[1] - 1) < 1e-9 and got[2] == 0
    df = items.sparkSession.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert abs(ml.standardize(df, ["x"], 1).agg(F.max("x")).first()[0] - 1.5 / 1.29099) < 1e-4


def test_drift_is_beyond_the_limit(raw):
    items = clean.clean_items(raw, FEATURES, 1960, 2023)
    w = windows.count_windows(items, ["year", "id"], ["energy", "valence"], 10).cache()
    assert w.count() == 40 and w.agg(F.sum("n")).first()[0] == 400
    found = windows.drifts(w, ["energy", "valence"], 1.5).cache()
    assert all(abs(r.z) > 1.5 for r in found.collect())
    assert windows.overlaid(w, found).where("drift_z IS NOT NULL").count() == found.select("win").distinct().count()
    assert windows.window_size(1_000_000) == 16667 and windows.window_size(50) == 200 and windows.window_size(50, 60) == 60


def test_fences_are_ordered(raw):
    items = clean.clean_items(raw, FEATURES, 1960, 2023)
    assert all(r.low < r.high and r.n_out >= 0 for r in stats.outliers(items, FEATURES).collect())


def test_bracketed_quantiles_are_exact(spark):
    rng = random.Random(8)
    rows = [(rng.gauss(0, 1), float(rng.randint(0, 3)), None) for _ in range(5000)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    direct, bracketed = (quantiles(df, ["a", "b", "c"], probs, direct_rows=n) for n in (10_000, 10))
    for c in "abc":
        assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(direct[c], bracketed[c]))


def test_running_totals(spark):
    rows = [(k, k * 7 % 13) for k in range(50)]
    got = {r.k: r.total_v for r in running_total(spark.createDataFrame(rows, "k int, v long").repartition(4), ["k"], ["v"], ranges=5).collect()}
    assert got == {k: sum(v for j, v in rows if j <= k) for k, _ in rows}


# --- graphs

def test_pagerank_by_hand(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("C", "A"), ("D", "C")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "ABCD"], "id string")
    got = {r.id: r["rank"] for r in graph.pagerank(nodes, edges, rounds=150, tolerance=1e-7, normalize=False, dangling="drop").collect()}
    assert abs(got["D"] - 0.15) < 1e-9 and got["C"] > got["A"] > got["B"] > got["D"]
    assert abs(got["C"] - (0.15 + 0.85 * (got["A"] / 2 + got["B"] + got["D"]))) < 1e-5
    whole = graph.pagerank(nodes, edges.where("src <> 'C'"), rounds=30).agg(F.sum("rank")).first()[0]
    assert abs(whole - 1) < 1e-6


def test_components_triangles_and_labels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (6, 7)] + [(k, k + 1) for k in range(20, 50)], "src long, dst long")
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6, 7, *range(20, 51))], "id long")
    parts = {r.id: r.component for r in graph.components(nodes, edges).collect()}
    assert parts == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6} | {k: 20 for k in range(20, 51)}
    assert [tuple(sorted(r)) for r in graph.triangles(edges, nodes).collect()] == [(1, 2, 3)]
    coefficient = {r.id: r.coefficient for r in graph.clustering(nodes, edges).collect()}
    assert coefficient[1] == 1 and abs(coefficient[3] - 1 / 3) < 1e-9 and coefficient[5] == 0
    labels = graph.label_propagation(nodes, edges)
    assert labels.count() == nodes.count()
    assert -1 <= graph.modularity(nodes, edges, labels).first().q <= 1


def test_pagerank_stops_at_the_first_round_that_moves_too_little(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("C", "A"), ("D", "C")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "ABCD"], "id string")
    rank, links = dict.fromkeys("ABCD", 0.25), {"A": "BC", "B": "C", "C": "A", "D": "C"}
    while True:
        new = {p: 0.15 + 0.85 * sum(rank[q] / len(out) for q, out in links.items() if p in out) for p in rank}
        moved, rank = sum(abs(new[p] - rank[p]) for p in rank), new
        if moved < 1e-4:
            break
    got = {r.id: r["rank"] for r in graph.pagerank(nodes, edges, rounds=200, tolerance=1e-4, norm="l1", normalize=False, dangling="drop").collect()}
    assert all(abs(got[p] - rank[p]) < 1e-12 for p in rank)


def test_communities_are_numbered_by_size(spark):
    labels = spark.createDataFrame([(k, 9 if k < 5 else 4 if k < 7 else 3) for k in range(9)], "id long, label long")
    assert {r.id: r.community for r in graph.by_size(labels).collect()} == {k: 0 if k < 5 else 2 if k < 7 else 1 for k in range(9)}


def test_rings(spark):
    edges = spark.createDataFrame([(0, k) for k in range(1, 7)], "src long, dst long")
    rows = graph.ring_layout(spark.range(8), edges).collect()
    assert {r.id: r.ring for r in rows}[0] == 0 and all(0 <= r.x <= 100 and 0 <= r.y <= 100 for r in rows)


# --- models

def test_clusters_and_elbow(spark):
    rng = random.Random(3)
    rows = [(k, 10.0 * (k % 3) + rng.gauss(0, 0.3), 5.0 * (k % 3) + rng.gauss(0, 0.3)) for k in range(90)]
    df = ml.assemble(spark.createDataFrame(rows, "id long, x double, y double"), ["x", "y"]).cache()
    got = ml.by_size(ml.kmeans(df, 3).transform(df))
    assert ml.adjusted_rand(got.withColumn("t", F.col("id") % 3), "cluster", "t").first().ari == 1
    table = ml.sweep(df, range(2, 6)).cache()
    assert ml.best_k(table).first().k == 3 and ml.elbow(table).first().k == 3
    flat, shares = ml.pca2(df.drop("x", "y"))
    assert shares[0] > 0.95 and {"x", "y"} <= set(flat.columns)


def test_measures_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.9)] * 3 + [(0, 1, 0.6)] + [(1, 0, 0.4)] * 2 + [(0, 0, 0.1)] * 4, "y int, prediction int, score double")
    m = ml.measures(df).first()
    assert (m.accuracy, m.precision, m.recall) == (0.7, 0.75, 0.6)
    assert {(r.y, r.predicted): r.n for r in ml.confusion(df).collect()} == {(0, 0): 4, (0, 1): 1, (1, 0): 2, (1, 1): 3}
    assert abs(ml.auc(df).first().auc - (15 + 8) / 25) < 1e-6
    assert ml.roc_points(df).orderBy("threshold").first().tpr == 1


def test_forest_finds_the_odd_ones(spark):
    rng = random.Random(5)
    rows = [(k, rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(490)] + [(k, 9.0 + k % 3, -9.0) for k in range(490, 500)]
    got = {r.id: r.anomaly for r in ml.isolation_forest(spark.createDataFrame(rows, "id long, x double, y double"), ["x", "y"], ["id"]).collect()}
    assert sum(got[k] for k in range(490, 500)) >= 8 and sum(got.values()) <= 15


def test_ward_by_hand(spark):
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate([0, 1, 10, 11, 50])], "id long, x double")
    got = {r.id: r.cluster for r in ml.ward(df, ["x"], "id", 3).collect()}
    assert got[0] == got[1] and got[2] == got[3] and len(set(got.values())) == 3
    with pytest.raises(Exception, match="at most"):
        ml.ward(spark.range(121).withColumn("x", F.col("id") * 1.0), ["x"], "id", 2).collect()


def test_ward_tree_by_hand(spark):
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate([0, 1, 10, 12])], "id long, x double")
    rows = ml.ward_tree(df, ["x"], "id").collect()
    merges = sorted((r for r in rows if r.step is not None), key=lambda r: r.step)
    assert [(r.n, round(r.height, 4)) for r in merges] == [(2, 1.0), (2, 2.0), (4, round((2 * 2 * 2 / 4) ** 0.5 * 10.5, 4))]
    assert {r.leaf: r.x for r in rows if r.step is None} == {0: 5.0, 1: 15.0, 2: 25.0, 3: 35.0}
    assert (merges[2].x, merges[2].x_left, merges[2].low_left, merges[2].x_right, merges[2].low_right) == (20.0, 10.0, 1.0, 30.0, 2.0)
    assert [r.leaf for r in ml.ward_tree(df.limit(1), ["x"], "id").collect()] == [0]


def test_ward_of_all_rows(spark):
    values = [(k, float(c * 100 + k % 7)) for k, c in enumerate([0] * 60 + [1] * 30 + [2] * 10)]
    df = ml.assemble(spark.createDataFrame(values, "id long, x double"), ["x"])
    got = {r.id: r.cluster for r in ml.ward_all(df, 3, centres=15).collect()}
    assert len(got) == 100 and len({(values[k][1] // 100, c) for k, c in got.items()}) == 3
    assert set(ml.ward_members(ml.ward_linkage(ml.np.array([[0.0]])), 1, 3)) == {0}


def test_one_class_is_an_error(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "y int")
    with pytest.raises(ValueError, match="two classes"):
        ml.require_classes(df)
    assert ml.require_classes(df.union(spark.createDataFrame([(0,)], "y int"))).count() == 4


def test_stream_features():
    assert events.pick_features(FEATURES) == ["energy", "acousticness", "valence", "danceability"]
    assert events.pick_features(["a", "b", "c", "d"]) == ["a", "b", "c"]


def test_kept_result(spark, tmp_path):
    path, cache = str(tmp_path / "t.csv"), str(tmp_path / "cache")
    (tmp_path / "t.csv").write_text("a\n1\n")
    first = spark.range(1).select(F.lit(1).cast("long").alias("n"))
    other = spark.range(1).select(F.lit(2).cast("long").alias("n"))
    assert files.kept_result(first, path, cache).first().n == 1
    assert files.kept_result(other, path, cache).first().n == 1
    assert files.kept_result(other, path, cache, version="2").first().n == 2
    (tmp_path / "t.csv").write_text("a\n1\n2\n")
    assert files.kept_result(other, path, cache).first().n == 2


# --- documents, streams, runs

def test_paths_and_values(spark):
    df = spark.createDataFrame([('{"a":{"b":[{"c":5}]},"e":[],"n":null}',)], "doc string")
    row = df.select(docs.json_path("doc", "a.b.0.c").alias("c"), docs.json_path("doc", "x", "none").alias("x"), docs.has_value("doc", "e").alias("e"), docs.has_value("doc", "a").alias("a")).first()
    assert (row.c, row.x, row.e, row.a) == ("5", "none", False, True)
    nested = spark.createDataFrame([(1, ("x", [1]))], "id int, s struct<a string, b array<int>>")
    assert docs.leaf_paths(nested.schema) == [("id", "int"), ("s.a", "string"), ("s.b", "array<int>")]


def test_document_store(spark, tmp_path):
    df = spark.createDataFrame([("a", "done", (3,)), ("b", "failed", (7,))], "id string, state string, config struct<k int>")
    one, two, three = (str(tmp_path / x) for x in ("one", "two", "three"))
    documents.append(df, one)
    documents.append(spark.createDataFrame([("c", "queued", (5,))], df.schema), one)
    assert [r.id for r in documents.find(spark, one, df.schema, order=["id"], limit=2).collect()] == ["c", "b"]
    assert documents.find(spark, one, df.schema, F.col("config.k") > 4).count() == 2
    documents.change(spark, one, two, df.schema, F.col("id") == "c", {"state": F.lit("done")})
    assert documents.find(spark, two, df.schema, F.col("state") == "done").count() == 2
    documents.drop(spark, two, three, df.schema, F.col("state") == "failed")
    assert {r.id for r in documents.find(spark, three, df.schema).collect()} == {"a", "c"}


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(4).write.parquet(str(tmp_path / "in"))
    live = events.windowed_counts(events.event_stream(spark, str(tmp_path / "in"), source.schema), lag="60 days")
    query = live.writeStream.outputMode("complete").format("memory").queryName("live_counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("live_counts").collect())) == sorted(map(tuple, events.windowed_counts(source).collect()))


def test_stream_into_files(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(2).write.parquet(str(tmp_path / "in"))
    live = events.event_stream(spark, str(tmp_path / "in"), source.schema).select("event_id", "ts")
    for _ in range(2):  # the second run finds nothing new
        events.run_available(live, str(tmp_path / "out"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == source.count()


def test_late_events_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", 5), ("a", 3), ("a", 9), ("b", 1), ("b", 0)], "k string, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = events.late_by_key(events.event_stream(spark, str(tmp_path / "in"), df.schema), "k")
    late.writeStream.outputMode("update").format("memory").queryName("late_counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {r.key: (r.n, r.n_late) for r in spark.table("late_counts").collect()} == {"a": (3, 1), "b": (2, 1)}


def test_run_config():
    c = pipeline.RunConfig(year_from=2000, year_to=1990, features=("energy", "nonsense"))
    assert (c.year_from, c.year_to, c.features) == (1990, 2000, ("energy",))
    assert pipeline.RunConfig(features=("nonsense",)).features == pipeline.FEATURES
    assert c.clamped(1995, 1998).year_from == 1995 and c.clamped(1995, 1998).year_to == 1998
    for bad in ({"k": 1}, {"k": 13}, {"sample_fraction": 0.01}):
        with pytest.raises(ValueError):
            pipeline.RunConfig(**bad)


def test_whole_run(raw):
    run = pipeline.run(raw, pipeline.RunConfig(k=3))
    assert {s.status for s in run.stages} == {"done"}, run.stages
    assert run.items.count() == 400 and run.tables["profile"].count() == 3
    assert len({r.label for r in run.tables["profile"].collect()}) == 3
    assert abs(run.tables["shares"].agg(F.sum("share_pct")).first()[0] - 100) < 0.5


def test_a_failing_analysis_leaves_the_others():
    run = pipeline.Run()
    assert run.record("bad", lambda: 1 / 0) is None and run.record("good", lambda: 1) == 1
    assert [s.status for s in run.stages] == ["failed", "done"]


def test_drift_queries_tell_of_all_steps_beyond_one_and_a_half():
    from trackloom.plans.queries import SQL

    assert "abs(z) > 1.5" in SQL["st_drift"] and SQL["st_drift_overlay"].count("abs(z) > 1.5") == 2


def test_clustering_makes_its_input_once(spark):
    made = spark.sparkContext.accumulator(0)

    def told(x):
        made.add(1)
        return float(x % 7)

    df = spark.range(60).select(F.col("id"), F.udf(told, "double")("id").alias("a"), F.rand(1).alias("b"))
    assert pipeline.cluster(df, ["a", "b"], 3).count() == 60
    assert made.value == 60


def test_the_graph_of_a_run_has_all_items(raw):
    items = clean.clean_items(raw, FEATURES, 1960, 2023).withColumn("cluster", F.lit(0))
    tables = pipeline.analyses(items, pipeline.RunConfig(k=3), items.limit(0))["graph"]()
    assert tables["density"].first().n == 400 and tables["communities"].agg(F.sum("size")).first()[0] == 400


def test_scratch_tables_go_and_others_stay(spark):
    exists = lambda df: spark.sparkContext._jvm.java.io.File(df.inputFiles()[0].removeprefix("file://")).exists()
    with scratch(spark):
        here, there = stored(spark.range(9)), stored(spark.range(9), stays=True)
        order = numbered(here, ["id"])
        assert exists(here) and order.inputFiles() and order.count() == 9
        order = order.select("id").inputFiles()
    assert not exists(here) and exists(there) and stored(there).count() == 9
    assert not spark.sparkContext._jvm.java.io.File(order[0].removeprefix("file://")).exists()
    with pytest.raises(ZeroDivisionError), scratch(spark):
        here = stored(spark.range(9))
        1 / 0
    assert not exists(here) and exists(there)


def test_the_first_of_a_key_by_all_columns(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (1, None, 5), (2, "c", 1)], "k int, s string, n int")
    assert {tuple(r) for r in clean.first_by_key(df, "k", ["s", "n"]).collect()} == {tuple(r) for r in clean.first_by_key(df, "k", ["n", "s"]).where("k = 2").collect()} | {(1, None, 5)}
