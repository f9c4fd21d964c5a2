"""The forest over counts, and what a split moves."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from trackloom.operators import forest, ml


def rows(spark, n=4000, copies=1):
    rng = np.random.default_rng(1)
    x = np.round(rng.random((n, 3)), 2)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, v array<double>, y int").select("id", "y", array_to_vector("v").alias("features"))
    return df.crossJoin(spark.range(copies).select(F.col("id").alias("copy")))


def test_forest_learns_what_no_single_cut_tells(spark):
    df = rows(spark)
    model = forest.CountedForest(trees=20, depth=6).fit(df.where("id % 4 > 0"))
    assert isinstance(model, forest.Fitted)
    got = model.transform(df.where("id % 4 = 0"))
    assert got.columns == [*df.columns, "prediction"] and got.count() == 1000
    assert got.where("y = prediction").count() > 930
    told = model.featureImportances.toArray()
    assert abs(told.sum() - 1) < 1e-9 and told[2] < 0.1 < min(told[:2])


def test_copies_of_rows_make_no_more_cells(spark):
    """The trees' tasks get as many cells from copied rows as from the rows."""
    few, many = rows(spark, 500), rows(spark, 500, 20)
    cuts = [[0.25, 0.5, 0.75]] * 3
    cells = lambda df: forest.in_bins(df, cuts).select("_b0", "_b1", "_b2").distinct().count()
    assert cells(few) == cells(many) <= 64


def test_too_many_cells_are_left_to_the_library(spark):
    df = rows(spark, 400)
    model = forest.CountedForest(trees=3, depth=3, most_cells=10).fit(df)
    assert not isinstance(model, forest.Fitted) and "prediction" in model.transform(df).columns


def test_split_orders_only_the_rows_at_the_cut(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ml, "numbered", lambda df, *a, f=ml.numbered: seen.append(df.count()) or f(df, *a))
    got = ml.split(spark.range(3000), ["id"])
    assert got.where("split = 'train'").count() == 2100
    assert seen and max(seen) < 100


def test_split_of_rows_with_one_id_is_exact(spark):
    got = ml.split(spark.range(50).select(F.lit(1).alias("id")), ["id"])
    assert got.where("split = 'test'").count() == 15
