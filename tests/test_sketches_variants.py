"""Mergeable counts, open documents, table functions, exact silhouettes and splits, stores that are read in part."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from trackloom.operators import ml, sketches, text, variants
from trackloom.sources import documents, files


def test_sketches_add_up_over_days(spark, tmp_path):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("day"), (F.col("id") % 25_013).alias("v"))
    sketches.keep(sketches.by_group(rows, ["g", "day"], "v"), str(tmp_path / "s"), "day")
    exact = {r.g: (r.n, r.d) for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("v").alias("d")).collect()}
    for r in sketches.read(spark, str(tmp_path / "s"), ["g"]).collect():
        assert r.n == exact[r.g][0] and abs(r.estimate - exact[r.g][1]) < 0.02 * exact[r.g][1]
    # a day that comes again replaces itself and leaves the others
    sketches.keep(sketches.by_group(rows.where("day = 3").limit(5), ["g", "day"], "v"), str(tmp_path / "s"), "day")
    back = sketches.read(spark, str(tmp_path / "s"), ["day"])
    assert {r.day: r.n for r in back.collect()} == {r.day: 5 if r.day == 3 else r["count"] for r in rows.groupBy("day").count().collect()}
    only = sketches.read(spark, str(tmp_path / "s"), ["g"], where=F.col("day") == 2)
    assert only.agg(F.sum("n")).first()[0] == rows.where("day = 2").count()
    assert "PartitionFilters: [isnotnull(day" in only._jdf.queryExecution().executedPlan().toString()


DOCS = ['{"a":1,"b":{"c":[1,{"d":"x"}],"e":null}}', '{"a":"t","z":true,"y":{}}', "[1,2]", "bad{", None, "7", '{"a":{"deep":[[1.5],[]]}}']


def test_leaves_of_documents_of_any_shape(spark):
    df = spark.createDataFrame([(k, d) for k, d in enumerate(DOCS)], "k long, json string").select("k", variants.as_variant("json").alias("doc"))
    got = sorted((r.k, r.path, r.type, r.value) for r in variants.leaves(df, "doc", ["k"]).collect())

    def walk(value, path):
        if isinstance(value, dict) and value:
            for k, v in value.items():
                yield from walk(v, f"{path}.{k}")
        elif isinstance(value, list) and value:
            for v in value:
                yield from walk(v, f"{path}[]")
        else:
            yield path

    want = sorted((k, p) for k, d in enumerate(DOCS) if d and d != "bad{" for p in walk(json.loads(d), "$"))
    assert [x[:2] for x in got] == want
    assert (0, "$.b.c[].d", "STRING", "x") in got and (0, "$.b.e", "VOID", None) in got
    shape = variants.shape(df, "doc").first()
    assert (shape.documents, shape.broken) == (5, 2) and "VARIANT" in shape.shape
    told = {(r.path, r.type): (r.n, r.documents) for r in variants.leaf_summary(df, "doc").collect()}
    assert told["$[]", "BIGINT"] == (2, 1) and told["$.a", "BIGINT"] == (1, 1) and told["$.a", "STRING"] == (1, 1)
    assert variants.leaves(df.where("false"), "doc", ["k"]).collect() == []
    flat = variants.leaves(df, "doc", ["k"], levels=1).where("k = 0").collect()
    assert {r.path for r in flat} == {"$.a", "$.b"}


def test_paths_of_documents(spark):
    df = spark.createDataFrame([(d,) for d in DOCS[:2]], "json string").select(variants.as_variant("json").alias("doc"))
    rows = df.select(variants.at("doc", "a", "int", -1).alias("a"), variants.at("doc", "b.c.1.d", "string").alias("d")).collect()
    assert [tuple(r) for r in rows] == [(1, "x"), (-1, None)]


def test_open_store(spark, tmp_path):
    at = str(tmp_path / "docs")
    spark.createDataFrame([(d,) for d in DOCS], "json string").select(variants.as_variant("json").alias("doc")).transform(lambda df: documents.append_open(df, "doc", at) or df)
    with open(f"{at}/part-broken.txt", "w") as f:
        f.write('{"a": 5}\nnot json\n')
    back = documents.open_documents(spark, at)
    assert back.count() == 7 and back.where("doc IS NULL").count() == 1
    assert sorted(r[0] for r in back.select(variants.at("doc", "a", "int")).where(variants.at("doc", "a", "int").isNotNull()).collect()) == [1, 5]


def test_word_pairs_by_table_function(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(k % 9, k, " ".join(rng.choices(["cat", "dog", "the", "bird", "x"], k=rng.randint(0, 6))) or None) for k in range(200)]
    df = spark.createDataFrame(rows, "conv long, turn long, said string").repartition(5)
    want = {}
    for c in range(9):
        words = [w for k, t, s in sorted(rows, key=lambda r: r[1]) if k == c for w in (s or "").split() if w not in ("the", "x")]
        for a, b in zip(words, words[1:]):
            want[f"{a} {b}"] = want.get(f"{a} {b}", 0) + 1
    assert {r.key: r.n for r in text.word_pairs_by_table(df, "said", "conv", ["turn"]).collect()} == want
    assert {r.key: r.n for r in text.word_pairs(df, "said", "conv", ["turn"]).collect()} == want
    assert text.word_pairs_by_table(df.where("false"), "said", "conv", ["turn"]).collect() == []


def test_index_of_many_small_folds(spark, monkeypatch):
    monkeypatch.setattr(text, "HELD", 2)
    rows = [(k, " ".join(w for j, w in enumerate(["apple", "pear", "plum", "fig"]) if k % (j + 1) == 0)) for k in range(50)]
    got = {r.token: (r.df, r.postings, r.ids) for r in text.inverted_index(spark.createDataFrame(rows + [(None, "fig"), (7, None)], "id long, t string").repartition(4), "t", "id", head=3).collect()}
    assert got["apple"] == (50, 3, [0, 1, 2]) and got["plum"] == (17, 3, [0, 3, 6]) and got["fig"] == (14, 3, [0, 4, 8])


ODD = ['{"a":{"b":1},"a.b":2}', '{"a":{"b":[]}}', '{"a.b":1.5,"a":{"b":"x"}}', '{"a\\"b.c":1,"a\\"b":{"c":2}}', '{"a":[1,2,{"b":3}],"a[]":4}', '7', '"x"', "[]", "{}", "[[1],[2]]", "null", "no json", '{"a":{"b":1.5}}']


def test_leaves_that_share_a_path_count_their_document_once(spark):
    """Keys may hold what paths are written with; documents that can't repeat a path are not shuffled one by one."""
    df = spark.createDataFrame([(d,) for d in ODD * 3], "json string").repartition(4).select(variants.as_variant("json").alias("doc"))
    got = {(r.path, r.type): (r.n, r.documents, r["sample"]) for r in variants.leaf_summary(df, "doc").collect()}
    one = {("$.a.b", "BIGINT"): (6, 3, "1"), ("$.a.b", "ARRAY<VOID>"): (3, 3, "[]"), ("$.a.b", "DECIMAL(2,1)"): (6, 6, "1.5"), ("$.a.b", "STRING"): (3, 3, "x"), ("$.a\"b.c", "BIGINT"): (6, 3, "1")}
    more = {("$.a[]", "BIGINT"): (9, 3, "1"), ("$.a[].b", "BIGINT"): (3, 3, "3"), ("$", "BIGINT"): (3, 3, "7"), ("$", "STRING"): (3, 3, "x"), ("$", "ARRAY<VOID>"): (3, 3, "[]"), ("$", "OBJECT<>"): (3, 3, "{}"), ("$[][]", "BIGINT"): (6, 3, "1"), ("$", "VOID"): (3, 3, None)}
    assert got == one | more
    docs = spark.createDataFrame([(d,) for d in ODD], "json string").select("json", variants.as_variant("json").alias("doc")).where("doc IS NOT NULL")
    assert {r.json for r in docs.where(~variants.may_repeat_paths("doc")).collect()} == {'7', '"x"', "{}", "null", '{"a":{"b":1.5}}'}


@pytest.mark.parametrize("block", [7, 4096])
def test_silhouettes_equal_all_pairs(spark, block):
    rng = np.random.default_rng(1)
    m = np.concatenate([rng.standard_normal((40, 3)), rng.standard_normal((30, 3)) + 4, [[50.0, 0, 0]]])
    labels = [0] * 40 + [1] * 30 + [2]
    far = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    want = []
    for i, c in enumerate(labels):
        means = {x: far[i, [j for j, y in enumerate(labels) if y == x and j != i]].mean() for x in set(labels) if x != c or labels.count(x) > 1}
        a, b = means.get(c), min(v for x, v in means.items() if x != c)
        want.append(0 if a is None else (b - a) / max(a, b))
    df = spark.createDataFrame(list(zip(m.tolist(), labels)), "v array<double>, prediction int").select(array_to_vector("v").alias("features"), "prediction").repartition(3)
    got = sorted(r.silhouette for r in ml.silhouettes(df, block=block).collect())
    assert np.allclose(got, sorted(want), atol=1e-6)
    assert abs(ml.silhouette(df, distance="euclidean") - np.mean(want)) < 1e-6
    assert len(ml.silhouettes(df, rows=10).collect()) == 10
    assert ml.silhouette(df.withColumn("prediction", F.lit(1)), distance="euclidean") == 0


@pytest.mark.parametrize("n", [0, 1, 7, 100, 333])
def test_split_is_exact(spark, n):
    got = ml.split(spark.range(n), ["id"])
    assert got.where("split = 'test'").count() == math.ceil(round(0.3 * n, 6)) and got.count() == n
    again = {r.id: r.split for r in ml.split(spark.range(n).repartition(5), ["id"]).collect()}
    assert again == {r.id: r.split for r in got.collect()}


def test_best_model_by_f1(spark):
    one = lambda name, f1: spark.createDataFrame([(name, f1, 0.5)], "model string, f1 double, accuracy double")
    assert {r.model: r.best for r in ml.compared([one("b", 0.7), one("a", 0.7), one("c", 0.1)]).collect()} == {"a": True, "b": False, "c": False}


def test_no_nan_at_any_depth(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, (nan, [1.0, inf, None], {"k": nan, "j": 2.0}), [(-inf, "x"), (3.0, None)]), (2, None, None)], "id int, s struct<a double, l array<double>, m map<string,double>>, n array<struct<q double, w string>>")
    rows = [json.loads(r.json) for r in files.to_json(df).collect()]
    assert rows[0] == {"id": 1, "s": {"a": None, "l": [1.0, None, None], "m": {"k": None, "j": 2.0}}, "n": [{"q": None, "w": "x"}, {"q": 3.0, "w": None}]}
    assert rows[1] == {"id": 2, "s": None, "n": None}


def test_only_wanted_folders_are_read(spark, tmp_path):
    at = str(tmp_path / "items")
    files.save_items(spark.range(1000).select("id", (F.col("id") % 10 * 10 + 1900).alias("decade"), F.lit("x").alias("name")), at)
    spark.createDataFrame([(1910, "old"), (1950, "mid"), (1990, "new")], "decade long, era string").write.parquet(str(tmp_path / "eras"))
    wanted = spark.read.parquet(str(tmp_path / "eras")).where("era <> 'mid'")
    back = files.read_items(spark, at, values=wanted, columns=["id"])
    assert back.columns == ["decade", "id"] and back.count() == 200 and {r.decade for r in back.select("decade").distinct().collect()} == {1910, 1990}
    back.write.format("noop").mode("overwrite").save()
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert files.read_items(spark, at).count() == 1000
