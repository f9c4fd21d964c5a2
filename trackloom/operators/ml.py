"""Models and their measures. Fitting is MLlib's; measures are aggregates over predictions."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ..functions.ordering import LEAST_RANGES, RANGE_ROWS, numbered, running_total
from ..functions.written import kept
from .forest import CountedForest

SEED = 42
#: Hexadecimal digits of a row's hash by which a split counts rows before it orders any.
SPLIT_DIGITS = 4


def standardize(df: DataFrame, features: list[str], ddof: int = 0) -> DataFrame:
    """Features as z-scores in their place, by population (0) or sample (1) deviation; a constant feature is only centred."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in features], *[std(c).alias(f"_s_{c}") for c in features])
    z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0))
    joined = df.join(F.broadcast(stats), F.lit(True))
    return joined.select(*[z(c).alias(c) if c in features else F.col(c) for c in df.columns])


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def scaled_vectors(df: DataFrame, array_col: str) -> DataFrame:
    """df with `features`: the numbers of an array, all rows' of one length, standardised by sample deviation."""
    raw = df.withColumn("_raw", array_to_vector(F.col(array_col).cast("array<double>")))
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(raw).transform(raw).drop("_raw")


def kmeans(df: DataFrame, k: int, starts: int = 4, seed: int = SEED):
    """The best of several starts by cost, on a frame with `features`."""
    models = [KMeans(k=k, seed=seed + s).fit(df) for s in range(starts)]
    return min(models, key=lambda m: m.summary.trainingCost)


def by_size(df: DataFrame, label: str = "prediction") -> DataFrame:
    """Cluster numbers from 0 on by descending size, so that they don't depend on the start."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    rank = sizes.withColumn("cluster", (F.row_number().over(Window.orderBy(F.desc("_n"), label)) - 1).cast("int")).select(label, "cluster")
    return df.join(F.broadcast(rank), label)


def silhouette(df: DataFrame, label: str = "prediction", distance: str = "squaredEuclidean") -> float:
    """Mean silhouette over all rows; one cluster alone has none and gives 0. distance: `squaredEuclidean` and `cosine` need
    one pass over the rows (MLlib's); `euclidean` compares all rows with all."""
    if df.select(label).distinct().limit(2).count() < 2:
        return 0.0
    if distance == "euclidean":
        return float(silhouettes(df, label).agg(F.avg("silhouette")).first()[0])
    return ClusteringEvaluator(predictionCol=label, distanceMeasure=distance).evaluate(df)


def silhouettes(df: DataFrame, label: str = "prediction", *, features: str = "features", rows: int | None = None, block: int = 4_096) -> DataFrame:
    """(row, label, silhouette) by Euclidean distance to all rows, for all rows or for the first `rows` by a hash of their
    numbers. The asked rows go round in blocks; each task adds up their distances to its own rows by cluster, so that a
    block costs one pass, and its sums are few rows. A row alone in its cluster gets 0."""
    told = kept(df.select(F.xxhash64(vector_to_array(features)).alias("_h"), vector_to_array(features).alias("v"), F.col(label).cast("int").alias("label")))
    asked = numbered(told, ["_h", "v", "label"], "row").select("row", "v", "label")
    n = told.count()
    sums = None
    for first in range(0, min(n, rows or n), block):
        own = asked.where(F.col("row").between(first + 1, min(first + block, rows or n))).collect()  # a block at most
        part = distance_sums(told, [r.row for r in own], np.array([r.v for r in own]))
        sums = part if sums is None else sums.unionByName(part)
    if sums is None:
        return df.sparkSession.createDataFrame([], "row long, label int, silhouette double")
    by_cluster = sums.groupBy("row", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    cells = asked.select("row", "label").join(by_cluster, "row")
    inside = F.col("cluster") == F.col("label")
    a = F.max(F.when(inside & (F.col("n") > 1), F.col("total") / (F.col("n") - 1)))
    b = F.min(F.when(~inside, F.col("total") / F.col("n")))
    told = cells.groupBy("row", "label").agg(a.alias("a"), b.alias("b"))
    return told.select("row", "label", F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)).alias("silhouette"))


def distance_sums(told: DataFrame, places: list[int], block: np.ndarray) -> DataFrame:
    """(row, cluster, total, n): the distances of each row of a block to all rows of a cluster, added up in each task."""
    shared = told.sparkSession.sparkContext.broadcast((places, block))

    def run(batches):
        places, q = shared.value
        total: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        squares = (q * q).sum(1)[:, None]
        for batch in batches:
            m = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            labels = batch.column(1).to_numpy()
            step = max(1, (32 << 20) // (8 * len(q)))
            for at in range(0, len(m), step):
                own, kinds = m[at : at + step], labels[at : at + step]
                far = np.sqrt(np.maximum(squares + (own * own).sum(1) - 2 * q @ own.T, 0))
                for c in np.unique(kinds).tolist():
                    hit = kinds == c
                    total[c] = total.get(c, 0) + far[:, hit].sum(1)
                    count[c] = count.get(c, 0) + int(hit.sum())
        for c, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([c] * len(q), pa.int32()), pa.array(x), pa.array([count[c]] * len(q), pa.int64())], ["row", "cluster", "total", "n"])

    return told.select("v", "label").mapInArrow(run, "row long, cluster int, total double, n long")


def sweep(df: DataFrame, ks=range(2, 11), starts: int = 1) -> DataFrame:
    """(k, inertia, silhouette) for each number of clusters."""
    rows = []
    for k in ks:
        model = kmeans(df, k, starts)
        rows.append((k, float(model.summary.trainingCost), float(silhouette(model.transform(df)))))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def best_k(table: DataFrame) -> DataFrame:
    """The k of the highest silhouette, the smallest of equals."""
    return table.where("silhouette IS NOT NULL").agg(F.max_by("k", F.struct("silhouette", (-F.col("k")).alias("o"))).alias("k"))


def elbow(table: DataFrame) -> DataFrame:
    """The k furthest from the chord of k and inertia, both scaled to 0..1; the first of equals."""
    bounds = table.agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("inertia").alias("i0"), F.max("inertia").alias("i1"))
    x = (F.col("k") - F.col("k0")) / F.coalesce(F.nullif(F.col("k1") - F.col("k0"), F.lit(0)), F.lit(1))
    y = (F.col("inertia") - F.col("i0")) / F.coalesce(F.nullif(F.col("i1") - F.col("i0"), F.lit(0.0)), F.lit(1.0))
    far = table.join(F.broadcast(bounds), F.lit(True)).withColumn("distance", F.round(F.abs(x + y - 1) / F.sqrt(F.lit(2.0)), 6))
    return far.agg(F.max_by("k", F.struct("distance", (-F.col("k")).alias("o"))).alias("k"), F.max("distance").alias("distance"))


def pca2(df: DataFrame) -> tuple[DataFrame, list[float]]:
    """df with x and y, its first two components, the sign such that the largest loading is positive; and their shares of variance."""
    model = PCA(k=2, inputCol="features", outputCol="_pc").fit(df)
    loads = model.pc.toArray()
    sign = [1.0 if loads[np.abs(loads[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    at = vector_to_array("_pc")
    return model.transform(df).withColumn("x", at[0] * sign[0]).withColumn("y", at[1] * sign[1]).drop("_pc"), [float(v) for v in model.explainedVariance]


def split(df: DataFrame, id_cols: list[str], train: float = 0.7, seed: int = SEED) -> DataFrame:
    """df with `split`: the first of its rows by a hash of their ids (then by the ids) are train, the others test. The sizes
    are exact, test has its share rounded up; the same in every run. Rows are counted by the first digits of their hashes,
    so only those whose digits the cut falls into are put in order, and no others are moved."""
    h = F.md5(F.concat_ws("|", *id_cols, F.lit(seed)).cast("binary"))
    hashed = df.withColumn("_hash", h).withColumn("_part", F.conv(F.substring("_hash", 1, SPLIT_DIGITS), 16, 10).cast("int"))
    sizes = sorted((r._part, r.n) for r in hashed.groupBy("_part").agg(F.count("*").alias("n")).collect())  # 16 ** SPLIT_DIGITS rows at most
    n = sum(size for _, size in sizes)
    n_train = n - math.ceil(round((1 - train) * n, 6))
    cut, left = -1, n_train
    for cut, size in sizes:
        if left < size:
            break
        left -= size
    side = lambda first: F.when(first, "train").otherwise("test")
    told = hashed.where(F.col("_part") != cut).withColumn("split", side(F.col("_part") < cut))
    ranges = LEAST_RANGES if dict(sizes).get(cut, 0) <= RANGE_ROWS else None
    near = numbered(hashed.where(F.col("_part") == cut), ["_hash", *id_cols], "_place", ranges).withColumn("split", side(F.col("_place") <= left)).drop("_place")
    return told.unionByName(near).drop("_hash", "_part")


def classifiers(n_train: int) -> dict:
    """The three models of the comparison."""
    return {
        "random_forest": CountedForest(trees=100, depth=12, seed=SEED),
        "decision_tree": DecisionTreeClassifier(labelCol="y", maxDepth=8, seed=SEED),
        "logistic": LogisticRegression(labelCol="y", regParam=1.0 / max(1, n_train), elasticNetParam=0.0, standardization=False, maxIter=1000),
    }


def measures(df: DataFrame, y: str = "y", predicted: str = "prediction") -> DataFrame:
    """accuracy, precision, recall, F1 and balanced accuracy of the positive class, four decimals; 0 where undefined."""
    t, p = F.col(y) == 1, F.col(predicted) == 1
    c = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    out = {"accuracy": over(tp + tn, tp + fp + fn + tn), "precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "f1": over(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": (over(tp, tp + fn) + over(tn, tn + fp)) / 2}
    return c.select(*[F.round(v, 4).alias(k) for k, v in out.items()])


def compared(tables: list[DataFrame]) -> DataFrame:
    """The measures of several models, one row each, with best: whether none has a higher F1 (the first name of equals)."""
    every = functools.reduce(DataFrame.unionByName, tables)
    top = F.broadcast(every.agg(F.min(F.struct((-F.col("f1")).alias("f"), "model")).alias("_top")))
    return every.join(top, F.lit(True)).withColumn("best", F.col("model") == F.col("_top.model")).drop("_top")


def confusion(df: DataFrame, y: str = "y", predicted: str = "prediction") -> DataFrame:
    """(y, predicted, n) for all four cells."""
    cells = F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("predicted"), F.count_if((F.col(y) == a) & (F.col(predicted) == b)).alias("n")) for a in (0, 1) for b in (0, 1)])
    return df.agg(cells.alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def scores_in_order(df: DataFrame, y: str, score: str) -> DataFrame:
    """(score, p, q, total_p, total_q) for each distinct score: positives and negatives there, and from the highest score
    down to it. The order spans the table, so it is cut into ranges."""
    by_score = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("q"))
    return running_total(by_score.withColumn("_down", -F.col("score")), ["_down"], ["p", "q"]).drop("_down")


def auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """One row: area under the ROC curve, equal scores counted half."""
    told = scores_in_order(df, y, score)
    # a positive beats all negatives but those at its score and above
    lost = F.sum(F.col("p") * (F.col("total_q") - F.col("q") / 2.0))
    return told.agg(F.round(1 - lost / (F.sum("p") * F.sum("q")), 6).alias("auc"))


def roc_points(df: DataFrame, y: str = "y", score: str = "score", points: int = 60) -> DataFrame:
    """(threshold, fpr, tpr) at so many places of the curve and at its end."""
    told = numbered(scores_in_order(df, y, score).withColumn("_down", -F.col("score")), ["_down"], "_k")
    total = F.broadcast(told.agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"), F.count("*").alias("_n")))
    step = F.greatest((F.col("_n") / points).cast("long"), F.lit(1))
    picked = told.join(total, F.lit(True)).where(((F.col("_k") - 1) % step == 0) | (F.col("_k") == F.col("_n")))
    return picked.select(F.col("score").alias("threshold"), F.round(F.col("total_q") / F.col("_q"), 4).alias("fpr"), F.round(F.col("total_p") / F.col("_p"), 4).alias("tpr"))


def importances(model, features: list[str], spark) -> DataFrame:
    """(feature, importance) of a fitted forest or tree, four decimals."""
    return spark.createDataFrame([(f, round(float(v), 4)) for f, v in zip(features, model.featureImportances.toArray())], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def inertia(df: DataFrame, features: list[str], label: str = "cluster") -> DataFrame:
    """One row: the sum of squared distances of all rows from the mean of their cluster."""
    return df.groupBy(label).agg(*[(F.var_pop(c) * F.count(c)).alias(c) for c in features]).agg(F.round(F.sum(sum((F.col(c) for c in features[1:]), F.col(features[0]))), 4).alias("inertia"))


def require_classes(df: DataFrame, y: str = "y") -> DataFrame:
    """df itself; an error if its target has fewer than two values."""
    if df.select(y).where(F.col(y).isNotNull()).distinct().limit(2).count() < 2:
        raise ValueError(f"{y} needs rows of two classes")
    return df


def class_balance(df: DataFrame, y: str = "y") -> DataFrame:
    return df.groupBy("split").agg(F.count_if(F.col(y) == 1).alias("positives"), F.count_if(F.col(y) == 0).alias("negatives"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: agreement of two labellings beyond chance."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs("n").alias(name))
    all_ = cells.agg(pairs("n").alias("both"), F.sum("n").alias("n")).join(side(a, "a"), F.lit(True)).join(side(b, "b"), F.lit(True))
    chance = F.col("a") * F.col("b") / (F.col("n") * (F.col("n") - 1) / 2.0)
    most = (F.col("a") + F.col("b")) / 2.0
    return all_.select(F.round(F.when(most == chance, 1.0).otherwise((F.col("both") - chance) / (most - chance)), 6).alias("ari"))


def isolation_forest(df: DataFrame, features: list[str], id_cols: list[str], *, trees: int = 50, sample: int = 256, contamination: float = 0.02, seed: int = SEED) -> DataFrame:
    """df with score and anomaly (the rows of the highest scores, `contamination` of them). Each tree grows in a task of
    its own from rows that a hash picks; the forest, bounded by trees * sample, is broadcast to score all rows."""
    depth = int(np.ceil(np.log2(sample)))
    n = df.count()
    share = min(1.0, 2.0 * sample / max(n, 1))
    picks = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), *[F.col(c).alias(f"_id_{k}") for k, c in enumerate(id_cols)])
    h = F.xxhash64("tree", F.lit(seed), *[f"_id_{k}" for k in range(len(id_cols))])
    picks = picks.where(F.pmod(h, F.lit(1_000_000)) < int(1_000_000 * share)).select("tree", h.alias("_h"), *features)

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        x = rows.sort_values("_h")[features].to_numpy()[:sample]
        rng, out, todo = np.random.default_rng(seed + tree), [], [(0, np.arange(len(x)), 0)]
        while todo:
            node, own, level = todo.pop()
            f = int(rng.integers(len(features)))
            low, high = (x[own, f].min(), x[own, f].max()) if len(own) else (0, 0)
            if level >= depth or len(own) <= 1 or low == high:
                out.append((tree, node, -1, 0.0, len(own)))
                continue
            cut = float(rng.uniform(low, high))
            out.append((tree, node, f, cut, len(own)))
            todo += [(2 * node + 1, own[x[own, f] < cut], level + 1), (2 * node + 2, own[x[own, f] >= cut], level + 1)]
        return pd.DataFrame(out, columns=["tree", "node", "f", "cut", "n"])

    grown = picks.groupBy("tree").applyInPandas(grow, "tree int, node long, f int, cut double, n long").collect()
    forest: dict[int, dict[int, tuple[int, float, int]]] = {}
    for r in grown:
        forest.setdefault(r.tree, {})[r.node] = (r.f, r.cut, r.n)
    shared = df.sparkSession.sparkContext.broadcast(forest)
    mean_depth = lambda m: 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m if m > 2 else float(m == 2)
    scale = mean_depth(sample)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        total = np.zeros(len(x))
        for tree in shared.value.values():
            todo = [(0, np.arange(len(x)), 0)]
            while todo:
                node, own, level = todo.pop()
                f, cut, n_ = tree[node]
                if f < 0:
                    total[own] += level + mean_depth(n_)
                    continue
                left = x[own, f] < cut
                todo += [(k, o, level + 1) for k, o in ((2 * node + 1, own[left]), (2 * node + 2, own[~left])) if len(o)]
        return pd.Series(2.0 ** (-total / len(shared.value) / scale))

    scored = df.withColumn("score", score(*[F.col(c).cast("double") for c in features]))
    cut = scored.agg(F.percentile_approx("score", 1 - contamination, 10_000).alias("_cut"))
    return scored.join(F.broadcast(cut), F.lit(True)).withColumn("anomaly", F.col("score") > F.col("_cut")).drop("_cut")


def ward_linkage(x: np.ndarray, weights: list[int] | None = None) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, height, size) of Ward's method; rows are nodes 0 to n - 1 and the merge s makes node n + s. A row
    may stand for several of them by its weight. Costs of all pairs are kept, and those of a merged cluster made anew."""
    n, merges = len(x), []
    centre, size, node = np.array(x, float), np.array(weights or [1] * len(x), float), np.arange(n)
    alive = np.ones(n, bool)
    to_all = lambda i: np.where(alive & (np.arange(n) != i), ((centre - centre[i]) ** 2).sum(1) * 2 * size[i] * size / (size[i] + size), np.inf)
    cost = np.array([to_all(i) for i in range(n)])
    for s in range(n - 1):
        i, j = divmod(int(cost.argmin()), n)
        a, b = sorted((int(node[i]), int(node[j])))
        height = float(np.sqrt(cost[i, j]))
        centre[i] = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
        size[i], node[i], alive[j] = size[i] + size[j], n + s, False
        cost[j], cost[:, j] = np.inf, np.inf
        cost[i] = cost[:, i] = to_all(i)
        merges.append((a, b, height, int(size[i])))
    return merges


def ward_members(merges: list[tuple[int, int, float, int]], n: int, clusters: int) -> list[int]:
    """The cluster of each of n nodes when only so many clusters are left, numbered by their first nodes."""
    held = {k: [k] for k in range(n)}
    for s, (a, b, _, _) in enumerate(merges[: max(n - clusters, 0)]):
        held[n + s] = held.pop(a) + held.pop(b)
    member = {k: c for c, own in enumerate(sorted(held.values(), key=min)) for k in own}
    return [member[k] for k in range(n)]


def ward_all(df: DataFrame, clusters: int, centres: int = 120, seed: int = SEED) -> DataFrame:
    """df, of any size and with `features`, with `cluster`: each row goes to the nearest of so many centres of k-means, and
    Ward's method joins the centres, weighted by their rows. Only centres and their counts reach the driver."""
    model = KMeans(k=centres, seed=seed).fit(df)
    near = model.transform(df)
    sizes = {r.prediction: r.n for r in near.groupBy("prediction").agg(F.count("*").alias("n")).collect()}
    held = sorted(sizes)
    x = np.array([model.clusterCenters()[c] for c in held])
    members = ward_members(ward_linkage(x, [sizes[c] for c in held]), len(held), clusters)
    rows = df.sparkSession.createDataFrame(list(zip(held, members)), "prediction int, cluster int")
    return near.join(F.broadcast(rows), "prediction").drop("prediction")


def one_group(df: DataFrame, features: list[str], id_col: str, limit: int) -> GroupedData:
    """All rows as one group, after their number is checked."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"Ward's method takes at most {limit} rows")
    return df.select(F.col(id_col).alias("id"), *features, F.lit(1).alias("_all")).groupBy("_all")


def ward(df: DataFrame, features: list[str], id_col: str, clusters: int, limit: int = 120) -> DataFrame:
    """(id, cluster) by Ward's method on at most `limit` rows, which the caller samples; more are an error, as the method
    needs all distances at once."""
    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        return pd.DataFrame({"id": rows["id"], "cluster": ward_members(ward_linkage(rows[features].to_numpy(float)), len(rows), clusters)})

    kind = df.schema[id_col].dataType.simpleString()
    return one_group(df, features, id_col, limit).applyInPandas(cut, f"id {kind}, cluster int").withColumnRenamed("id", id_col)


def ward_tree(df: DataFrame, features: list[str], id_col: str, limit: int = 120) -> DataFrame:
    """The tree of Ward's method: a row for each merge (step, n, height, and the two ends and the top of its bracket: x_left,
    low_left, x_right, low_right) and for each leaf (leaf, x; step null). Leaves stand at 5, 15, 25 and so on."""
    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        n, merges = len(rows), ward_linkage(rows[features].to_numpy(float))
        order, todo = [], [n + len(merges) - 1]
        while todo:
            node = todo.pop()
            if node < n:
                order.append(node)
            else:
                todo += [merges[node - n][1], merges[node - n][0]]
        x, low = {k: 5.0 + 10 * p for p, k in enumerate(order)}, dict.fromkeys(range(n), 0.0)
        leaves = [(rows["id"].iloc[k], None, 1, 0.0, x[k], None, None, None, None) for k in order]
        brackets = []
        for s, (a, b, height, size) in enumerate(merges):
            x[n + s], low[n + s] = (x[a] + x[b]) / 2, height
            brackets.append((None, s, size, height, x[n + s], x[a], low[a], x[b], low[b]))
        return pd.DataFrame(leaves + brackets, columns=["leaf", "step", "n", "height", "x", "x_left", "low_left", "x_right", "low_right"]).astype({"step": "Int64"})

    kind = df.schema[id_col].dataType.simpleString()
    return one_group(df, features, id_col, limit).applyInPandas(draw, f"leaf {kind}, step long, n long, height double, x double, x_left double, low_left double, x_right double, low_right double")
