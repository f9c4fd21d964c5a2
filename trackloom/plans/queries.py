"""The queries over the tables, each with its SQL where SQL can express it.

Whole numbers are BIGINT and reals DOUBLE on both sides; reals are rounded; every order has a tie-break.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import numbered, running_max
from ..functions.text import STOP_WORDS, code_points, code_sum, credits, human_size, shortened, tokens
from ..operators import bloom, clean, dendrogram, docs, graph, ml, relational, sketches, stats, text, variants, windows
from ..functions.written import shared_folder
from ..sources import documents
from ..sources.files import read_items, save_items, scan_table, to_json
from ..streaming import count_windows
from ..streaming import events as streams
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLAGS = ["A", "N", "R"]


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, reals as DOUBLE."""
    to = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    kind = lambda t: "double" if t.startswith("decimal") else to.get(t)
    return df.select(*[F.col(f"`{c}`").cast(kind(t)).alias(c) if kind(t) else F.col(f"`{c}`") for c, t in df.dtypes])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return scan_table(spark, sf, name)


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as items with a year, a decade, a group and four measures."""
    return table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate")).withColumn("decade", clean.decade_of(F.col("year"))).withColumn("flag", F.col("l_returnflag"))


ITEMS = "(SELECT *, year(l_shipdate)::BIGINT AS year, (year(l_shipdate)//10*10)::BIGINT AS decade, l_returnflag AS flag FROM lineitem)"
EVENTS = "(SELECT event_id, ts, user_id, event_type, value, props FROM events)"


# --- scans, projection, cleaning

@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def scan_parquet(spark, sf):
    return plain(table(spark, sf, "region"))


@query("SELECT l_returnflag, l_quantity FROM lineitem")
def project_cols(spark, sf):
    return clean.project(table(spark, sf, "lineitem"), ["l_returnflag", "l_quantity", "no_such_column"])


@query("SELECT DISTINCT year(o_orderdate)::BIGINT AS year FROM orders")
def scan_column_pruned(spark, sf):
    return plain(scan_table(spark, sf, "orders", ["o_orderdate"]).select(F.year("o_orderdate").alias("year")).distinct())


@query("SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) AS number, try_cast(substr(o_orderpriority, 3) AS DOUBLE) AS none FROM orders")
def cast_safe(spark, sf):
    t = table(spark, sf, "orders").withColumn("a", F.substring("o_orderpriority", 1, 1)).withColumn("b", F.expr("substring(o_orderpriority, 3)"))
    return t.select("o_orderkey", clean.as_number("a").alias("number"), clean.as_number("b").alias("none"))


@query("SELECT o_orderkey, trunc(try_cast((year(o_orderdate) || '.9') AS DOUBLE))::BIGINT AS year FROM orders")
def cast_year(spark, sf):
    t = table(spark, sf, "orders").withColumn("text", F.concat(F.year("o_orderdate").cast("string"), F.lit(".9")))
    return plain(t.select("o_orderkey", clean.as_year("text").alias("year")))


@query(f"SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber, year FROM {ITEMS} WHERE year BETWEEN 1996 AND 1998")
def filter_range(spark, sf):
    return plain(items(spark, sf).where(F.col("year").between(1996, 1998)).select("l_orderkey", "l_partkey", "l_linenumber", "year"))


@query(f"SELECT decade, count(*) AS n FROM {ITEMS} GROUP BY decade")
def derive_decade(spark, sf):
    return plain(relational.count_by(items(spark, sf), ["decade"]))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer WHERE c_acctbal >= 0")
def dropna_subset(spark, sf):
    t = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    return clean.drop_missing(t, ["balance"])


@query("SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part) WHERE k = 1")
def dedup_first(spark, sf):
    return clean.first_by_key(table(spark, sf, "part").select("p_name", "p_partkey", "p_brand"), "p_name", ["p_partkey"])


@query("SELECT c_custkey FROM customer ORDER BY md5(c_custkey::VARCHAR || '|42'), c_custkey LIMIT (SELECT round(0.25 * count(*))::BIGINT FROM customer)")
def sample_fraction(spark, sf):
    """A quarter of the customers: sampling is the feature here."""
    return clean.sample_fraction(table(spark, sf, "customer").select("c_custkey"), 0.25, ["c_custkey"])


@query("SELECT c_custkey FROM customer ORDER BY md5(c_custkey::VARCHAR || '|42'), c_custkey LIMIT 100")
def sample_cap(spark, sf):
    """A hundred customers: sampling is the feature here."""
    return clean.sample_exact(table(spark, sf, "customer").select("c_custkey"), 100, ["c_custkey"])


@query("SELECT o_orderkey, greatest(1997, least(year(o_orderdate), 1999))::BIGINT AS year FROM orders")
def config_clamp(spark, sf):
    return plain(table(spark, sf, "orders").select("o_orderkey", clean.clamp(F.year("o_orderdate"), F.lit(1997), F.lit(1999)).alias("year")))


@query("SELECT c.c_custkey, coalesce(sum(o.o_totalprice::DECIMAL(18,2)), 0)::DOUBLE AS spent FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
def fill_zero(spark, sf):
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"))
    out = table(spark, sf, "customer").select("c_custkey").join(spent, "c_custkey", "left")
    return plain(out.na.fill({"spent": 0}))


# --- counts, shares, profiles

@query(f"SELECT year, flag, count(*) AS n FROM {ITEMS} GROUP BY year, flag")
def agg_count_by(spark, sf):
    return plain(relational.count_by(items(spark, sf), ["year", "flag"]))


@query(f"SELECT year, count(*) FILTER (WHERE flag = 'A') AS \"A\", count(*) FILTER (WHERE flag = 'N') AS \"N\", count(*) FILTER (WHERE flag = 'R') AS \"R\" FROM {ITEMS} GROUP BY year")
def agg_decade_cluster_pivot(spark, sf):
    return plain(relational.pivot_counts(items(spark, sf), "year", "flag", FLAGS))


@query(f"SELECT year, count(*) AS total, " + ", ".join(f"round(100.0 * count(*) FILTER (WHERE flag = '{f}') / count(*), 2)::DOUBLE AS \"{f}\"" for f in FLAGS) + f" FROM {ITEMS} GROUP BY year")
def agg_shares(spark, sf):
    """The flagship: how the groups' shares move with time."""
    return plain(relational.row_shares(relational.pivot_counts(items(spark, sf), "year", "flag", FLAGS), "year", FLAGS))


@query(f"SELECT flag, count(*) AS n, " + ", ".join(f"round(avg({c}), 4) AS mean_{c}" for c in MEASURES) + f", round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 2)::DOUBLE AS share_pct FROM {ITEMS} GROUP BY flag")
def agg_cluster_profile(spark, sf):
    return plain(relational.profile(items(spark, sf), "flag", MEASURES))


@query(" UNION ALL ".join(f"SELECT year, '{c}' AS feature, round(avg({c}), 4) AS mean FROM {ITEMS} GROUP BY year" for c in MEASURES))
def agg_feature_trend(spark, sf):
    return plain(relational.trend(items(spark, sf), "year", MEASURES))


@query("SELECT year, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in MEASURES) + f" FROM {ITEMS} GROUP BY year")
def trend_rows(spark, sf):
    return plain(relational.trend_rows(relational.trend(items(spark, sf), "year", MEASURES), "year", MEASURES))


@query("SELECT count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types, count(DISTINCT p_name) AS names FROM part")
def agg_distinct(spark, sf):
    return table(spark, sf, "part").agg(F.countDistinct("p_brand").alias("brands"), F.countDistinct("p_type").alias("types"), F.countDistinct("p_name").alias("names"))


@query("SELECT l_returnflag AS flag, count(*) AS n, count(DISTINCT l_orderkey) AS exact, true AS close FROM lineitem GROUP BY l_returnflag")
def agg_distinct_sketched(spark, sf):
    """Distinct orders of each group from sketches by group and month, beside the exact number: within two in a hundred."""
    lines = items(spark, sf).select("flag", F.trunc("l_shipdate", "month").alias("month"), "l_orderkey")
    told = sketches.estimates(sketches.merged(sketches.by_group(lines, ["flag", "month"], "l_orderkey"), ["flag"]))
    exact = lines.groupBy("flag").agg(F.countDistinct("l_orderkey").alias("exact"))
    return told.join(exact, "flag").select("flag", "n", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.02 * F.col("exact")).alias("close"))


@query("SELECT 'open' AS query, count(*) FILTER (WHERE o_orderstatus = 'O') AS n FROM orders UNION ALL SELECT 'dear', count(*) FILTER (WHERE o_totalprice > 200000) FROM orders UNION ALL SELECT 'urgent', count(*) FILTER (WHERE o_orderpriority LIKE '1%') FROM orders UNION ALL SELECT 'cheap and done', count(*) FILTER (WHERE o_totalprice < 50000 AND o_orderstatus = 'F') FROM orders")
def agg_conditional(spark, sf):
    p = F.col("o_totalprice")
    return docs.count_matches(table(spark, sf, "orders"), {"open": F.col("o_orderstatus") == "O", "dear": p > 200000, "urgent": F.col("o_orderpriority").startswith("1"), "cheap and done": (p < 50000) & (F.col("o_orderstatus") == "F")})


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus ORDER BY n DESC, o_orderstatus")
def agg_group_sort(spark, sf):
    return relational.count_by(table(spark, sf, "orders"), ["o_orderstatus"]).orderBy(F.desc("n"), "o_orderstatus")


@query("SELECT n_name, c_custkey, c_acctbal FROM (SELECT n.n_name, c.*, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey) WHERE k = 1")
def agg_argmax(spark, sf):
    t = relational.lookup_join(table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), table(spark, sf, "nation"), "n_nationkey", "n_name")
    best = t.groupBy("n_name").agg(F.max_by(F.struct("c_custkey", "c_acctbal"), F.struct("c_acctbal", (-F.col("c_custkey")).alias("o"))).alias("b"))
    return best.select("n_name", "b.c_custkey", "b.c_acctbal")


@query("WITH c AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY c_mktsegment) AS size, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, c_nationkey) AS k FROM c) SELECT c_mktsegment, size::BIGINT AS size, c_nationkey::BIGINT AS mode, round(100.0 * n / size, 2)::DOUBLE AS mode_pct FROM r WHERE k = 1")
def agg_mode(spark, sf):
    return plain(relational.mode_by(table(spark, sf, "customer"), "c_mktsegment", "c_nationkey"))


@query("WITH b AS (SELECT greatest(ceil(max(p_size) / 2.0), 1)::BIGINT AS bins FROM part), g AS (SELECT unnest(range(bins)) AS bin FROM b), c AS (SELECT least(p_size // 2, bins - 1) AS bin, count(*) AS n FROM part, b GROUP BY ALL) SELECT g.bin::BIGINT AS bin, g.bin * 2 AS low, coalesce(n, 0)::BIGINT AS n FROM g LEFT JOIN c ON g.bin = c.bin")
def agg_histogram(spark, sf):
    return plain(relational.histogram(table(spark, sf, "part"), "p_size", 2))


@query(f"SELECT flag, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS share_pct FROM {ITEMS} GROUP BY flag")
def win_share(spark, sf):
    return plain(relational.with_share(relational.count_by(items(spark, sf), ["flag"])))


@query(f"WITH c AS (SELECT year, flag, count(*) AS n FROM {ITEMS} GROUP BY ALL), s AS (SELECT *, n / max(n) OVER () AS share FROM c) SELECT year, flag, n, round(share, 4) AS heat, least(floor(share * 7), 6)::BIGINT AS colour FROM s")
def heat_norm(spark, sf):
    return plain(stats.heat(relational.count_by(items(spark, sf), ["year", "flag"]), "n"))


@query(f"SELECT coalesce(year::VARCHAR, '(all)') AS year, coalesce(flag, '(all)') AS flag, count(*) AS n FROM {ITEMS} GROUP BY ROLLUP (year, flag)")
def agg_rollup(spark, sf):
    return relational.rollup_counts(items(spark, sf), ["year", "flag"])


# --- joins, order, paging

LABELS = [("A", "returned"), ("N", "new")]


@query("SELECT label, count(*) AS n FROM lineitem JOIN (VALUES ('A', 'returned'), ('N', 'new')) t(flag, label) ON l_returnflag = flag GROUP BY label")
def join_broadcast(spark, sf):
    labels = spark.createDataFrame(LABELS, "flag string, label string")
    return relational.count_by(relational.lookup_join(items(spark, sf).select("flag"), labels, "flag", "label"), ["label"])


@query("SELECT coalesce(label, 'Cluster ' || l_returnflag) AS label, count(*) AS n FROM lineitem LEFT JOIN (VALUES ('A', 'returned'), ('N', 'new')) t(flag, label) ON l_returnflag = flag GROUP BY 1")
def join_inner_left_variants(spark, sf):
    labels = spark.createDataFrame(LABELS, "flag string, label string")
    return relational.count_by(relational.lookup_join(items(spark, sf).select("flag"), labels, "flag", "label", default=F.concat(F.lit("Cluster "), F.col("flag"))), ["label"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_stale(spark, sf):
    return relational.missing_from(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders"), "c_custkey", "o_custkey")


@query("SELECT coalesce(s_suppkey, c_custkey) AS key, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS name, CASE WHEN s_suppkey IS NULL THEN 'stored' ELSE 'live' END AS origin FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def join_overlay(spark, sf):
    stored = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    live = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return relational.overlay(stored, live, "key", ["name"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def page_offset(spark, sf):
    """The third page: paging is the feature here."""
    return relational.page(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 3, 50).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def page_total(spark, sf):
    """The third page with the number of all rows: paging is the feature here."""
    return relational.page_with_total(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 3, 50).select("o_orderkey", "o_totalprice", "total")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def limit_recent(spark, sf):
    """The newest 25: a top list is the feature here."""
    return relational.top_n(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 25, ["o_orderkey"])


@query("SELECT p_name AS key, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 15")
def sort_ranked_rows(spark, sf):
    """The 15 most frequent: a top list is the feature here."""
    return relational.top_n(relational.count_by(table(spark, sf, "part").withColumnRenamed("p_name", "key"), ["key"]), "n", 15, ["key"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
def sort_stable_event(spark, sf):
    return plain(numbered(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "rn"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'ste') OR contains(lower(p_type), 'ste')")
def search_tracks(spark, sf):
    return relational.search(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), "STE", ["p_name", "p_type"])


#: The rules of relational.label_rules.
LABEL_SQL = """CASE WHEN i >= 0.5 THEN 'Instrumental / Ambient' WHEN s >= 0.15 THEN 'Spoken / Lyrical' WHEN a >= 0.55 AND e <= 0.5 THEN 'Acoustic / Organic'
 WHEN e >= 0.75 AND a <= 0.2 THEN 'High-Energy Electronic' WHEN d >= 0.6 AND v >= 0.6 THEN 'Bright / Upbeat' WHEN d >= 0.6 THEN 'Rhythmic / Dance'
 WHEN e >= 0.68 AND a <= 0.3 THEN 'High-Energy Electronic' WHEN e >= 0.7 AND l >= -6 THEN 'Loud / Intense' WHEN e <= 0.4 AND v <= 0.45 THEN 'Mellow / Low-Energy' ELSE 'Vocal / Pop' END"""


@query(f"""WITH f AS (SELECT vec_id, abs(embedding[1]::DOUBLE) * 4 AS a, abs(embedding[2]::DOUBLE) * 4 AS e, abs(embedding[3]::DOUBLE) * 4 AS d, abs(embedding[4]::DOUBLE) * 4 AS v, abs(embedding[5]::DOUBLE) AS s, abs(embedding[6]::DOUBLE) * 2 AS i, embedding[7]::DOUBLE * 40 AS l FROM embeddings),
 b AS (SELECT vec_id, {LABEL_SQL} AS base FROM f) SELECT vec_id, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY vec_id) > 1 THEN base || ' (C' || vec_id || ')' ELSE base END AS label FROM b""")
def ml_label(spark, sf):
    names = ["acousticness", "energy", "danceability", "valence", "speechiness", "instrumentalness"]
    at = lambda k: F.col("embedding")[k].cast("double")
    mean = {n: F.abs(at(k)) * f for k, (n, f) in enumerate(zip(names, (4, 4, 4, 4, 1, 2)))} | {"loudness": at(6) * 40}
    return relational.tell_apart(table(spark, sf, "embeddings").select("vec_id", relational.label_rules(mean).alias("label")), "label", "vec_id")


# --- statistics

def per_feature(select: str, features: list[str] = MEASURES) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {select.replace('{c}', c)} FROM lineitem" for c in features)


@query(per_feature("count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS max, round(max({c}) - min({c}), 6) AS range"))
def eda_describe(spark, sf):
    return plain(stats.describe(table(spark, sf, "lineitem"), MEASURES))


@query(per_feature("round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurtosis"))
def eda_skew_kurt(spark, sf):
    return plain(stats.skew_kurtosis(table(spark, sf, "lineitem"), MEASURES))


PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]]
CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM lineitem" for a, b in PAIRS)


@query(CORR)
def eda_corr(spark, sf):
    return stats.correlations(table(spark, sf, "lineitem"), MEASURES)


@query(f"SELECT * FROM ({CORR}) ORDER BY abs(r) DESC, a, b LIMIT 3")
def eda_top_pairs(spark, sf):
    """The three strongest: a top list is the feature here."""
    return stats.top_pairs(stats.correlations(table(spark, sf, "lineitem"), MEASURES), 3)


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(max(lo), 6) AS low, round(max(hi), 6) AS high, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS n_out, round(100.0 * count(*) FILTER (WHERE {c} < lo OR {c} > hi) / count({c}), 4)::DOUBLE AS pct_out FROM {t}, (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {t})" for c, t in (("value", "events"),)))
def eda_iqr(spark, sf):
    return plain(stats.outliers(table(spark, sf, "events"), ["value"]))


@query("SELECT 'a' AS feature, round(avg((p_size < 10)::INT) * 100, 4) AS missing_pct FROM part UNION ALL SELECT 'b', round(avg((p_retailprice > 1200)::INT) * 100, 4) FROM part")
def eda_missing(spark, sf):
    t = table(spark, sf, "part").select(F.when(F.col("p_size") >= 10, F.col("p_size")).alias("a"), F.when(~(F.col("p_retailprice") > 1200), F.col("p_retailprice")).alias("b"))
    return stats.missing(t, ["a", "b"])


@query("WITH y AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 0 ELSE year(o_orderdate) END::BIGINT AS year FROM orders) SELECT count(*) AS n_rows, 1::BIGINT AS n_columns, min(year) FILTER (WHERE year > 0) AS min_year, max(year) FILTER (WHERE year > 0) AS max_year, trunc(quantile_cont(year, 0.01) FILTER (WHERE year > 0))::BIGINT AS p01_year, trunc(quantile_cont(year, 0.99) FILTER (WHERE year > 0))::BIGINT AS p99_year, min(year) AS raw_min_year, count(*) FILTER (WHERE year <= 0) AS n_invalid FROM y")
def profile_dataset(spark, sf):
    y = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "P", 0).otherwise(F.year("o_orderdate")).alias("year"))
    return plain(stats.dataset_profile(y))


@query(f"WITH d AS (SELECT decade, count(*) AS n FROM {ITEMS} GROUP BY decade), o AS (SELECT n, least(decade + 9, 2000) - greatest(decade, 1997) + 1 AS o FROM d) SELECT round(sum(n * o / 10.0))::BIGINT AS estimate FROM o WHERE o > 0")
def estimate_rows(spark, sf):
    return stats.estimate_rows(relational.count_by(items(spark, sf), ["decade"]), 1997, 2000)


# --- words

STOP_SQL = "('" + "','".join(STOP_WORDS) + "')"
TOKENS_SQL = f"SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z'']{{3,}}')) AS key FROM documents"
TOKEN_ROWS = f"(SELECT * FROM ({TOKENS_SQL}) WHERE key NOT IN {STOP_SQL})"


@query(f"SELECT key, count(*) AS n FROM {TOKEN_ROWS} GROUP BY key")
def mr_word_count(spark, sf):
    return text.word_count(scan_table(spark, sf, "documents", ["text"]), "text")


@query(f"SELECT year, count(*) AS n, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in MEASURES) + f" FROM {ITEMS} GROUP BY year")
def mr_aggregates(spark, sf):
    return plain(text.means_by_key(items(spark, sf), "year", MEASURES))


@query("WITH c AS (SELECT unnest([p_brand, p_type]) AS key FROM part) SELECT key, count(*) AS n FROM c GROUP BY key ORDER BY n DESC, key LIMIT 15")
def topn_artists(spark, sf):
    """The 15 most frequent names: a top list is the feature here."""
    line = F.concat(F.lit("['"), F.col("p_brand"), F.lit("', '"), F.col("p_type"), F.lit("']"))
    return relational.top_n(text.map_reduce(table(spark, sf, "part"), credits(line), [F.count("*").alias("n")]), "n", 15, ["key"])


@query("SELECT p_partkey, unnest([p_brand, p_type]) AS credit FROM part")
def split_credits(spark, sf):
    line = F.concat(F.lit("['"), F.col("p_brand"), F.lit("'; \""), F.col("p_type"), F.lit("\", nan]"))
    return table(spark, sf, "part").select("p_partkey", F.explode(credits(line)).alias("credit"))


@query(f"WITH d AS (SELECT DISTINCT key AS token, doc_id FROM {TOKEN_ROWS}), r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY token) AS df FROM d) SELECT token, max(df) AS df, least(max(df), 8) AS postings, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM r WHERE k <= 8 GROUP BY token")
def mr_inverted_index(spark, sf):
    index = text.inverted_index(scan_table(spark, sf, "documents", ["doc_id", "text"]), "text", "doc_id")
    return index.select("token", "df", "postings", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(f"SELECT count(DISTINCT doc_id) AS df, 'thing' AS token FROM {TOKEN_ROWS} WHERE key = 'thing'")
def index_lookup(spark, sf):
    index = text.inverted_index(scan_table(spark, sf, "documents", ["doc_id", "text"]), "text", "doc_id")
    return text.lookup(index, "thing").select("df", "token")


@query("SELECT p_partkey, substr(p_name, 1, 8) AS short, ascii(substr(p_name, 1, 1))::BIGINT AS first_code, list_sum(list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, i, 1))))::BIGINT AS code_sum FROM part")
def text_functions(spark, sf):
    return plain(table(spark, sf, "part").select("p_partkey", shortened(F.col("p_name"), 8).alias("short"), code_points(F.col("p_name"))[0].alias("first_code"), code_sum(F.col("p_name")).alias("code_sum")))


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 1024 THEN floor(o_totalprice)::BIGINT || 'B' WHEN o_totalprice < 1048576 THEN printf('%.1fK', round(o_totalprice / 1024, 1)) ELSE printf('%.1fM', round(o_totalprice / 1048576, 1)) END AS size FROM orders")
def size_format(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", human_size(F.col("o_totalprice")).alias("size"))


PAIRS = f"WITH t AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[a-z'']{{3,}}'), lambda w: w NOT IN {STOP_SQL}) AS words FROM conversations), c AS (SELECT flatten(list(words ORDER BY turn)) AS w FROM t GROUP BY conv_id) SELECT key, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS key FROM c) GROUP BY key"


@query(PAIRS)
def mr_word_pairs(spark, sf):
    """Words that follow each other in a conversation, across its turns."""
    return text.word_pairs(scan_table(spark, sf, "conversations", ["conv_id", "turn", "text"]), "text", "conv_id", ["turn"])


@query(PAIRS)
def mr_word_pairs_table(spark, sf):
    """The same by a table function over each conversation's turns in order."""
    return text.word_pairs_by_table(scan_table(spark, sf, "conversations", ["conv_id", "turn", "text"]), "text", "conv_id", ["turn"])


# --- order of events

LATE = "(SELECT o_orderkey, o_orderdate, o_totalprice, max(o_orderdate) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM orders)"


@query(f"SELECT o_orderkey, latest FROM {LATE}")
def win_running_max(spark, sf):
    return running_max(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderkey"], F.col("o_orderdate"), "latest").select("o_orderkey", "latest")


@query(f"WITH l AS (SELECT coalesce(o_orderdate < latest, false) AS late, (epoch_us(latest) - epoch_us(o_orderdate)) // 1000000 AS s FROM {LATE}) SELECT count(*) AS n, count(*) FILTER (WHERE late) AS n_late, round(100.0 * count(*) FILTER (WHERE late) / count(*), 3)::DOUBLE AS pct_late, max(s) FILTER (WHERE late)::BIGINT AS max_late, round(avg(s) FILTER (WHERE late), 4) AS mean_late FROM l")
def st_late(spark, sf):
    late = windows.late_events(table(spark, sf, "orders"), "o_orderkey", "o_orderdate")
    seconds = F.expr("(unix_micros(cast(latest AS timestamp)) - unix_micros(cast(o_orderdate AS timestamp))) div 1000000")
    return plain(windows.late_summary(late, seconds))


SIZE = "(SELECT greatest(200, ceil(count(*) / 60.0))::BIGINT FROM orders)"
WIN = f"(SELECT ((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // {SIZE})::BIGINT AS win, * FROM orders)"
WINDOWS = f"(SELECT win, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last, round(avg(o_totalprice), 4) AS o_totalprice FROM {WIN} GROUP BY win)"
SMOOTH = f"(SELECT *, avg(o_totalprice) OVER (ORDER BY win ROWS 2 PRECEDING) AS rolling FROM {WINDOWS})"
DIFF = f"(SELECT *, rolling - lag(rolling) OVER (ORDER BY win) AS diff FROM {SMOOTH})"
DRIFT = f"""(SELECT *, CASE WHEN win >= 9 AND c >= 3 AND sd > 1e-9 THEN (diff - m) / sd END AS z FROM
 (SELECT *, avg(diff) OVER w AS m, stddev_pop(diff) OVER w AS sd, count(diff) OVER w AS c FROM {DIFF} WINDOW w AS (ORDER BY win ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)))"""


def order_windows(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    return windows.count_windows(orders, ["o_orderdate", "o_orderkey"], ["o_totalprice"], windows.window_size(orders.count()))


@query(f"SELECT * FROM {WINDOWS}")
def st_tumbling_count(spark, sf):
    return plain(order_windows(spark, sf))


@query("SELECT date_trunc('day', ts)::TIMESTAMP::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def st_tumbling_time(spark, sf):
    out = streams.windowed_counts(table(spark, sf, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n", "total")


@query("WITH e AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS day, value FROM events) SELECT day::TIMESTAMP::VARCHAR AS day, count(*) AS n FROM e GROUP BY 1")
def st_sliding(spark, sf):
    out = windows.time_windows(table(spark, sf, "events"), "ts", "2 days", [F.count("*").alias("n")], "1 day")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("day"), "n")


@query(f"SELECT win, round(rolling, 4) AS rolling FROM {SMOOTH}")
def win_rolling_mean(spark, sf):
    return windows.smoothed(order_windows(spark, sf), "o_totalprice").select("win", F.round("rolling", 4).alias("rolling"))


@query(f"WITH RECURSIVE w AS MATERIALIZED (SELECT * FROM {WINDOWS}), e(win, x) AS (SELECT win, o_totalprice FROM w WHERE win = 0 UNION ALL SELECT w.win, e.x * 0.5 + w.o_totalprice * 0.5 FROM e JOIN w ON w.win = e.win + 1) SELECT win, round(x, 4) AS ewma FROM e")
def win_ewma(spark, sf):
    return windows.smoothed(order_windows(spark, sf), "o_totalprice").select("win", F.round("ewma", 4).alias("ewma"))


@query(f"SELECT win, round(diff, 4) AS diff FROM {DIFF}")
def win_diff(spark, sf):
    return windows.smoothed(order_windows(spark, sf), "o_totalprice").select("win", F.round("diff", 4).alias("diff"))


@query(f"SELECT win, round(z, 4) AS z FROM {DRIFT}")
def win_zscore(spark, sf):
    return windows.drift(order_windows(spark, sf), "o_totalprice").select("win", F.round("z", 4).alias("z"))


@query(f"SELECT win, 'o_totalprice' AS feature, round(z, 4) AS z FROM {DRIFT} WHERE abs(z) > 1.5")
def st_drift(spark, sf):
    return windows.drifts(order_windows(spark, sf), ["o_totalprice"], 1.5)


@query(f"SELECT win, n, CASE WHEN abs(z) > 1.5 THEN 'o_totalprice' END AS drift_feature, CASE WHEN abs(z) > 1.5 THEN round(z, 4) END AS drift_z FROM {DRIFT}")
def st_drift_overlay(spark, sf):
    w = order_windows(spark, sf)
    return windows.overlaid(w, windows.drifts(w, ["o_totalprice"], 1.5)).select("win", "n", "drift_feature", "drift_z")


@query("SELECT date_trunc('day', ts)::TIMESTAMP::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_equals_batch(spark, sf):
    """The daily counts of a stream over the same files, run to its end in complete mode."""
    folder, at = f"{sf}/events.parquet", shelf(spark)
    schema = spark.read.parquet(folder).schema
    reader = spark.readStream.schema(schema)
    source = reader.parquet(folder) if is_folder(spark, folder) else reader.option("pathGlobFilter", "events.parquet").parquet(sf)
    running = streams.windowed_counts(source).writeStream.outputMode("complete").option("checkpointLocation", f"{at}/c").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out"))
    running.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n", "total")


LIVE = """WITH w AS (SELECT event_type AS key, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 100 AS win, value FROM events), g AS (SELECT key, win::BIGINT AS win, count(*) AS n, round(avg(value), 4) AS mean FROM w GROUP BY ALL HAVING count(*) = 100),
 r AS (SELECT *, avg(mean) OVER (PARTITION BY key ORDER BY win ROWS 2 PRECEDING) AS rolling FROM g), d AS (SELECT *, rolling - lag(rolling) OVER (PARTITION BY key ORDER BY win) AS step FROM r),
 h AS (SELECT *, avg(step) OVER p AS m, stddev_pop(step) OVER p AS sd, count(step) OVER p AS c FROM d WINDOW p AS (PARTITION BY key ORDER BY win ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)), z AS (SELECT key, win, n, mean, CASE WHEN c = 8 AND sd > 1e-9 THEN round((step - m) / sd, 4) END AS z FROM h)"""


def live_windows(spark, sf):
    """Windows of a hundred events of each type, from a stream that takes the events' files as they come."""
    at, events = shelf(spark), table(spark, sf, "events")
    streams.in_arrival_order(events, ["ts", "event_id"], f"{at}/in", 4)
    live = count_windows.live_windows(streams.event_stream(spark, f"{at}/in", events.schema), "event_type", "ts", "event_id", ["value"], 100)
    with count_windows.rocks_state(spark):
        streams.run_available(live, f"{at}/out", f"{at}/c")
    return spark.read.schema(live.schema).parquet(f"{at}/out")


@query(f"{LIVE} SELECT * FROM z")
def st_live_windows(spark, sf):
    """Counts and means of live windows, and how far each step of their rolling mean is from the eight before it."""
    return live_windows(spark, sf).select("key", "win", "n", F.round("mean", 4).alias("mean"), F.round("z", 4).alias("z"))


@query(f"{LIVE} SELECT key, win, z FROM z WHERE abs(z) > 1.5")
def st_live_drift(spark, sf):
    """The live windows whose step stands out."""
    return live_windows(spark, sf).where(F.abs("z") > 1.5).select("key", "win", F.round("z", 4).alias("z"))


@query("""WITH o AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) * 5 // (SELECT count(*) FROM orders) AS batch FROM orders), m AS (SELECT batch, max(o_orderdate) AS top FROM o GROUP BY batch),
 w AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 1000 DAY AS mark FROM m) SELECT batch::BIGINT AS batch, count(*) AS n, count(*) FILTER (WHERE o_orderdate <= mark) AS dropped, round(100.0 * count(*) FILTER (WHERE o_orderdate <= mark) / count(*), 3)::DOUBLE AS pct_dropped FROM o JOIN w USING (batch) GROUP BY batch""")
def st_watermark(spark, sf):
    """What each batch of a stream of orders loses as later than a thousand days behind the latest. Spark lets a batch's own
    watermark, and the one before, pass before rows are late: the mark is that of two batches ago."""
    at, orders, name = shelf(spark), table(spark, sf, "orders"), f"losses_{uuid.uuid4().hex}"
    streams.in_arrival_order(orders, ["o_orderkey"], f"{at}/in", 5)
    live = streams.on_time(streams.event_stream(spark, f"{at}/in", orders.schema), "o_orderkey", "o_orderdate", "1000 days")
    with streams.Losses(spark, name) as losses:
        running = live.writeStream.queryName(name).outputMode("append").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).format("parquet").start(f"{at}/out")
        running.awaitTermination()
        return losses.table(running).select("batch", "n", "dropped", "pct_dropped")


def is_folder(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


# --- Bloom filter over customers' names

def places_sql(m: str, k: str) -> str:
    """The places of the word w, one a row; m and k are numbers or columns."""
    return f"""unnest(list_transform(range({k}), lambda i: (('0x' || substr(md5(w), 1, 15))::BIGINT % {m} + i * ((('0x' || substr(sha256(w), 1, 15))::BIGINT % {m} | 1) % {m})) % {m}))"""


def filter_sql(members: str, probes: str | None = None) -> str:
    """The common tables of a filter over members (w) whose size follows from their number: size (n, m, k), bits (bit) and
    hits (w, hit) of the probes."""
    asked = f""", hits AS (SELECT w, bool_and(bit IN (SELECT bit FROM bits)) AS hit FROM (SELECT w, {places_sql('m', 'k')} AS bit FROM (SELECT DISTINCT w FROM ({probes})), size) GROUP BY w)""" if probes else ""
    return f"""members AS MATERIALIZED (SELECT DISTINCT w FROM ({members}) WHERE w IS NOT NULL), counted AS (SELECT count(*) AS n, ceil(-count(*) * ln(0.01) / pow(ln(2), 2))::BIGINT AS m FROM members),
 size AS MATERIALIZED (SELECT n, m, greatest(round(m / n * ln(2)), 1)::BIGINT AS k FROM counted), bits AS MATERIALIZED (SELECT DISTINCT {places_sql('m', 'k')} AS bit FROM members, size){asked}"""


NAMES = "SELECT c_name AS w FROM customer"
PROBES = f"{NAMES} UNION SELECT s_name FROM supplier UNION SELECT p_name FROM part"
ABSENT = "SELECT 'absent ' || p_name || p_partkey AS w FROM part"
FILTER, HITS = f"WITH {filter_sql(NAMES)}", f"WITH {filter_sql(NAMES, PROBES)}"


def customer_names(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_name").alias("w"))


def customer_filter(spark, sf):
    return bloom.fit(customer_names(spark, sf), "w")


def probe_words(spark, sf):
    one = lambda t, c: table(spark, sf, t).select(F.col(c).alias("w"))
    return one("customer", "c_name").unionByName(one("supplier", "s_name")).unionByName(one("part", "p_name")).distinct()


@query("SELECT p_size::BIGINT AS n, ceil(-p_size * ln(0.01) / pow(ln(2), 2))::BIGINT AS m, greatest(round(ceil(-p_size * ln(0.01) / pow(ln(2), 2)) / p_size * ln(2)), 1)::BIGINT AS k FROM part")
def bloom_size(spark, sf):
    m, k = bloom.size_columns(F.col("p_size"))
    return plain(table(spark, sf, "part").select(F.col("p_size").alias("n"), m.alias("m"), k.alias("k")))


@query(f"{FILTER} SELECT bit FROM bits")
def bloom_build(spark, sf):
    return bloom.bits_of(customer_filter(spark, sf))


@query(f"{HITS} SELECT w, hit FROM hits")
def bloom_contains(spark, sf):
    return bloom.contains(customer_filter(spark, sf), probe_words(spark, sf), "w")


@query(f"{HITS} SELECT w, hit, CASE WHEN hit THEN 'scan' ELSE 'skip' END AS verdict FROM hits")
def bloom_prefilter(spark, sf):
    return bloom.prefilter(customer_filter(spark, sf), probe_words(spark, sf), "w")


@query(f"{HITS} SELECT w, CASE WHEN NOT hit THEN 'Not present' WHEN w IN (SELECT w FROM members) THEN 'True Positive' ELSE 'False Positive' END AS status FROM hits")
def bloom_lab(spark, sf):
    return bloom.verdicts(customer_filter(spark, sf), customer_names(spark, sf), probe_words(spark, sf), "w")


@query(f"{FILTER} SELECT count(*) AS bits_set, round(100.0 * count(*) / any_value(m), 4)::DOUBLE AS fill_pct, any_value(m) AS m, any_value(k) AS k, round(pow(1 - exp(-any_value(k) * any_value(n)::DOUBLE / any_value(m)), any_value(k)), 6) AS fpr, round(any_value(m) / 8.0 / 1024, 3)::DOUBLE AS kb FROM bits, size")
def bloom_metrics(spark, sf):
    return plain(bloom.metrics(customer_filter(spark, sf)))


@query(f"WITH {filter_sql(NAMES, ABSENT)} SELECT count(*) AS probes, count(*) FILTER (WHERE hit) AS false_positives FROM hits")
def bloom_empirical_fpr(spark, sf):
    """Words that no customer has, made of all parts' names, and how many of them seem to be customers'."""
    absent = table(spark, sf, "part").select(F.concat(F.lit("absent "), "p_name", F.col("p_partkey").cast("string")).alias("w"))
    return bloom.false_alarms(customer_filter(spark, sf), absent, "w")


@query(f"{FILTER} SELECT w, string_agg(bit::VARCHAR, ',' ORDER BY bit) AS bits FROM (SELECT DISTINCT w, {places_sql('m', 'k')} AS bit FROM members, size) GROUP BY w")
def bloom_positions(spark, sf):
    names = customer_names(spark, sf).distinct()
    m, k = bloom.sizes(names.count())
    places = F.array_sort(F.array_distinct(bloom.positions(F.col("w"), m, k)))
    return names.select("w", F.array_join(F.transform(places, lambda p: p.cast("string")), ",").alias("bits"))


@query("SELECT name, count(*) OVER () AS total FROM (SELECT DISTINCT unnest([p_brand, p_type]) AS name FROM part)")
def bloom_vocab(spark, sf):
    line = F.concat_ws("; ", "p_brand", "p_type")
    names = table(spark, sf, "part").select(F.explode(credits(line)).alias("name")).distinct()
    return names.join(F.broadcast(names.agg(F.count("*").alias("total"))), F.lit(True))


@query(f"{HITS} SELECT w FROM hits WHERE hit")
def semi_bloom(spark, sf):
    return bloom.may_hold(customer_filter(spark, sf), probe_words(spark, sf), "w")


def small_lab(m: int, k: int) -> str:
    bits = f"(SELECT DISTINCT {places_sql(str(m), str(k))} AS bit FROM (SELECT r_name AS w FROM region))"
    hits = f"(SELECT w, bool_and(bit IN (SELECT bit FROM {bits})) AS hit FROM (SELECT w, {places_sql(str(m), str(k))} AS bit FROM (SELECT r_name AS w FROM region UNION SELECT n_name FROM nation)) GROUP BY w)"
    return f"SELECT {m}::BIGINT AS m, w, CASE WHEN NOT hit THEN 'Not present' WHEN w IN (SELECT r_name FROM region) THEN 'True Positive' ELSE 'False Positive' END AS status FROM {hits}"


@query(f"{small_lab(32, 3)} UNION ALL {small_lab(11, 2)}")
def bloom_lab_small(spark, sf):
    """The five regions in filters of 32 and of 11 bits, probed with regions and nations."""
    members = table(spark, sf, "region").select(F.col("r_name").alias("w"))
    probes = members.unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("w"))).distinct()
    one = lambda m, k: bloom.verdicts(bloom.of_size(members, "w", m, k), members, probes, "w").select(F.lit(m).cast("long").alias("m"), "w", "status")
    return one(32, 3).unionByName(one(11, 2))


@query(f"SELECT w, string_agg(bit::VARCHAR, ',' ORDER BY i) AS places FROM (SELECT w, unnest(range(3)) AS i, {places_sql('32', '3')} AS bit FROM (SELECT r_name AS w FROM region)) GROUP BY w")
def bloom_insertions(spark, sf):
    return bloom.insertions(table(spark, sf, "region").select(F.col("r_name").alias("w")), "w", 32, 3)


@query(f"{FILTER} SELECT string_agg(CASE WHEN i IN (SELECT bit FROM bits) THEN '1' ELSE '0' END, '' ORDER BY i) AS preview FROM range(512) t(i), size WHERE i < m")
def bloom_preview(spark, sf):
    return bloom.preview(customer_filter(spark, sf))


@query(f"WITH {filter_sql(f'SELECT lower(trim(w)) AS w FROM ({NAMES})', f'SELECT lower(trim(w)) AS w FROM ({PROBES})')} SELECT w AS name, hit, w IN (SELECT w FROM members) AS exact, CASE WHEN NOT hit THEN 'absent' WHEN w IN (SELECT w FROM members) THEN 'present' ELSE 'false alarm' END AS verdict FROM hits")
def bloom_api(spark, sf):
    """All probes, whatever their case, against a filter over the customers' names, sized by their number."""
    members = customer_names(spark, sf)
    return bloom.lookup(bloom.fit(bloom.plain_names(members, "w"), "name"), members, probe_words(spark, sf), "w")


# --- graphs

KNN = """(WITH n AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), z AS (SELECT *, (x - avg(x) OVER (PARTITION BY i)) / coalesce(nullif(stddev_pop(x) OVER (PARTITION BY i), 0), 1) AS z FROM n),
 v AS (SELECT vec_id, list(z ORDER BY i) AS v FROM z GROUP BY vec_id), p AS (SELECT a.vec_id AS x, b.vec_id AS y, round(list_cosine_similarity(a.v, b.v), 6) AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY w DESC, y) AS k FROM p) SELECT least(x, y) AS src, greatest(x, y) AS dst, max(w) AS weight FROM r WHERE k <= 4 GROUP BY ALL)"""
NODES = "(SELECT vec_id::BIGINT AS id FROM embeddings)"
EDGES = f"(SELECT src, dst FROM {KNN})"
BOTH = f"(SELECT src, dst FROM {EDGES} UNION ALL SELECT dst, src FROM {EDGES})"
DEGREE = f"(SELECT id, count(src) AS degree FROM {NODES} LEFT JOIN {BOTH} ON id = src GROUP BY id)"


def near_graph(spark, sf):
    """Vectors as nodes, and an edge between each and its four nearest by standardised numbers."""
    vectors_ = table(spark, sf, "embeddings")
    return vectors_.select(F.col("vec_id").alias("id")), graph.kept(graph.knn_edges(vectors_, "vec_id", "embedding", 4, standardize=True, exact=True))


@query(f"SELECT * FROM {KNN}")
def graph_knn_build(spark, sf):
    return graph.knn_edges(table(spark, sf, "embeddings"), "vec_id", "embedding", 4, standardize=True, exact=True)


@query("WITH p AS (SELECT a.vec_id AS id, b.vec_id AS id2, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS weight FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, id2) AS rank FROM p) SELECT * FROM r WHERE rank <= 4")
def join_knn(spark, sf):
    """Each vector's four nearest, all of them, over cells of some hundred vectors."""
    return plain(graph.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", 4, exact=True, cell_rows=100))


@query("SELECT (4 * count(*))::BIGINT AS pairs, true AS found FROM embeddings")
def knn_recall(spark, sf):
    """Neighbours of all vectors as the measured number of cells finds them, and whether nine in ten are true ones."""
    near = lambda **how: graph.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", 4, cell_rows=100, **how)
    both = near().join(near(exact=True).select("id", "id2", F.lit(1).alias("true")), ["id", "id2"], "left")
    return both.agg(F.count("*").alias("pairs"), (F.sum("true") >= 0.9 * F.count("*")).alias("found"))


@query(f"SELECT id, degree FROM {DEGREE}")
def graph_degree(spark, sf):
    return plain(graph.degrees(*near_graph(spark, sf)))


@query(f"SELECT id, degree FROM {DEGREE} ORDER BY degree DESC, id LIMIT 10")
def topk_hubs(spark, sf):
    """The ten best connected: a top list is the feature here."""
    return relational.top_n(plain(graph.degrees(*near_graph(spark, sf))), "degree", 10, ["id"])


@query(f"SELECT count(*) AS n, (sum(degree) // 2)::BIGINT AS e, round(2.0 * (sum(degree) // 2) / (count(*) * (count(*) - 1)), 4)::DOUBLE AS density, round(avg(degree), 4) AS avg_degree, max(degree) AS max_degree, count(*) FILTER (WHERE degree = 0) AS isolated FROM {DEGREE}")
def graph_density(spark, sf):
    return plain(graph.density(*near_graph(spark, sf)))


@query(f"WITH k AS MATERIALIZED {KNN}, b AS (SELECT src, dst FROM k UNION ALL SELECT dst, src FROM k), d AS (SELECT vec_id AS id, count(src) AS degree FROM embeddings LEFT JOIN b ON vec_id = src GROUP BY vec_id), t AS (SELECT x.src AS id, count(*) AS links FROM b x JOIN b y ON x.src = y.src AND x.dst < y.dst JOIN k ON k.src = x.dst AND k.dst = y.dst GROUP BY x.src) SELECT d.id, round(CASE WHEN degree < 2 THEN 0 ELSE 2.0 * coalesce(links, 0) / (degree * (degree - 1)) END, 6)::DOUBLE AS coefficient FROM d LEFT JOIN t ON d.id = t.id")
def graph_clustering_coef(spark, sf):
    nodes, edges = near_graph(spark, sf)
    return graph.clustering(nodes, edges).select("id", F.round("coefficient", 6).alias("coefficient"))


@query(f"""WITH RECURSIVE b AS MATERIALIZED {BOTH}, r(id, c) AS (SELECT id, id FROM {NODES} UNION SELECT b.dst, r.c FROM r JOIN b ON r.id = b.src WHERE r.c < b.dst) SELECT id, min(c) AS component FROM r GROUP BY id""")
def graph_components(spark, sf):
    return graph.components(*near_graph(spark, sf))


LOST = "coalesce((SELECT sum(r) FROM {p} WHERE id NOT IN (SELECT src FROM o)), 0) / (SELECT count(*) FROM n)"


def ranks_sql(rounds: int, base: str, lost: str, fold: str, tolerance: float) -> str:
    """PageRank in SQL: all rounds one after the other, and the ranks of the first that moves by less than the tolerance, or
    of the last. Edges go both ways; ranks start at 1/n."""
    parts = [f"n AS MATERIALIZED {NODES}", f"b AS MATERIALIZED {BOTH}", "o AS MATERIALIZED (SELECT src, count(*) AS c FROM b GROUP BY src)", "p0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS r FROM n)"]
    for k in range(1, rounds + 1):
        parts.append(f"p{k} AS MATERIALIZED (SELECT n.id, {base} + 0.85 * (coalesce(g.i, 0) + {lost.replace('{p}', f'p{k - 1}')}) AS r FROM n LEFT JOIN (SELECT b.dst AS id, sum(p.r / o.c) AS i FROM b JOIN p{k - 1} p ON p.id = b.src JOIN o ON o.src = b.src GROUP BY b.dst) g ON g.id = n.id)")
    steps = " UNION ALL ".join(f"SELECT {k} AS k, {fold}(abs(x.r - y.r)) AS moved FROM p{k} x JOIN p{k - 1} y ON x.id = y.id" for k in range(1, rounds + 1))
    every = " UNION ALL ".join(f"SELECT {k} AS k, id, r FROM p{k}" for k in range(1, rounds + 1))
    parts += [f"steps AS MATERIALIZED ({steps})", f"done AS (SELECT coalesce(min(k) FILTER (WHERE moved < {tolerance}), {rounds}) AS k FROM steps)"]
    return f"(WITH {', '.join(parts)} SELECT id, round(r, 6) AS rank FROM ({every}) JOIN done USING (k))"


RANKS = ranks_sql(40, "0.15 / (SELECT count(*) FROM n)", LOST, "max", 1e-8)


def ranked_nodes(spark, sf):
    nodes, edges = near_graph(spark, sf)
    return graph.pagerank(nodes, graph.both_ways(edges)).select("id", F.round("rank", 6).alias("rank"))


@query(f"SELECT * FROM {RANKS}")
def graph_pagerank(spark, sf):
    """Until no rank moves by 1e-8, 40 rounds at most."""
    return ranked_nodes(spark, sf)


@query(f"SELECT * FROM {ranks_sql(100, '0.15', '0', 'sum', 1e-4)}")
def graph_pagerank_simple(spark, sf):
    """Ranks that start at 1/n and don't add up to 1, until they move by 1e-4 all together."""
    nodes, edges = near_graph(spark, sf)
    return graph.pagerank(nodes, graph.both_ways(edges), rounds=100, tolerance=1e-4, norm="l1", normalize=False, dangling="drop").select("id", F.round("rank", 6).alias("rank"))


@query(f"SELECT id, rank FROM {RANKS} ORDER BY rank DESC, id LIMIT 10")
def topk_influential(spark, sf):
    """The ten of the highest rank: a top list is the feature here."""
    return relational.top_n(ranked_nodes(spark, sf), "rank", 10, ["id"])


def votes_sql(rounds: int = 20) -> str:
    """Label propagation in SQL: all nodes move at once, their own label votes too."""
    parts = [f"v AS MATERIALIZED (SELECT src, dst FROM {BOTH} UNION SELECT id, id FROM {NODES})", f"l0 AS MATERIALIZED (SELECT id, id AS label FROM {NODES})"]
    for k in range(1, rounds + 1):
        parts.append(f"l{k} AS MATERIALIZED (SELECT id, label FROM (SELECT v.dst AS id, l.label, row_number() OVER (PARTITION BY v.dst ORDER BY count(*) DESC, l.label) AS k FROM v JOIN l{k - 1} l ON l.id = v.src GROUP BY v.dst, l.label) WHERE k = 1)")
    return f"(WITH {', '.join(parts)}, s AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS community FROM l{rounds} GROUP BY label) SELECT id, community::BIGINT AS community FROM l{rounds} JOIN s USING (label))"


FOUND = votes_sql()


def found_communities(nodes, edges):
    return graph.by_size(graph.label_propagation(nodes, edges))


@query(f"SELECT * FROM {FOUND}")
def graph_label_prop(spark, sf):
    return found_communities(*near_graph(spark, sf))


@query(f"WITH e AS MATERIALIZED {EDGES}, l AS MATERIALIZED (SELECT id, community AS label FROM {FOUND}), m AS (SELECT count(*) AS m FROM e), i AS (SELECT a.label, count(*) AS l FROM e JOIN l a ON e.src = a.id JOIN l b ON e.dst = b.id WHERE a.label = b.label GROUP BY a.label), d AS (SELECT label, sum(degree) AS d FROM {DEGREE} g JOIN l ON g.id = l.id GROUP BY label) SELECT round(sum(coalesce(i.l, 0) / m.m - pow(d.d / (2.0 * m.m), 2)), 6) AS q FROM d LEFT JOIN i ON d.label = i.label, m")
def graph_modularity(spark, sf):
    nodes, edges = near_graph(spark, sf)
    return graph.modularity(nodes, edges, graph.kept(found_communities(nodes, edges).withColumnRenamed("community", "label")))


@query(f"WITH t AS MATERIALIZED (SELECT g.id, degree, community, label AS cluster FROM {DEGREE} g JOIN {FOUND} f ON g.id = f.id JOIN embeddings ON g.id = vec_id), c AS (SELECT community, cluster, count(*) AS n FROM t GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, cluster) AS k FROM c), a AS (SELECT community, count(*) AS size, avg(degree) AS d FROM t GROUP BY community) SELECT a.community, a.size, round(100.0 * a.size / (SELECT count(*) FROM t), 2)::DOUBLE AS share_pct, round(d, 2) AS avg_degree, cluster::BIGINT AS dominant_cluster, CASE cluster WHEN 0 THEN 'Calm' WHEN 1 THEN 'Loud' ELSE 'Cluster ' || cluster END AS dominant_label, round(100.0 * n / a.size, 2)::DOUBLE AS dominant_share_pct FROM a JOIN x ON a.community = x.community AND x.k = 1")
def graph_community_summary(spark, sf):
    """Found communities with the cluster that most of their vectors have, and its label."""
    nodes, edges = near_graph(spark, sf)
    clusters = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("cluster"))
    told = graph.community_summary(nodes, edges, graph.kept(found_communities(nodes, edges)), clusters)
    labels = spark.createDataFrame([(0, "Calm"), (1, "Loud")], "dominant_cluster long, dominant_label string")
    return plain(relational.lookup_join(told, labels, "dominant_cluster", "dominant_label", default=F.concat(F.lit("Cluster "), F.col("dominant_cluster").cast("string"))))


@query(f"WITH r AS (SELECT id, degree, CASE WHEN degree / greatest(max(degree) OVER (), 1) >= 0.66 THEN 0 WHEN degree / greatest(max(degree) OVER (), 1) >= 0.33 THEN 1 ELSE 2 END AS ring FROM {DEGREE}), p AS (SELECT *, row_number() OVER (PARTITION BY ring ORDER BY degree DESC, id) - 1 AS k, count(*) OVER (PARTITION BY ring) AS n FROM r) SELECT id, ring::BIGINT AS ring, round(50 + [18, 34, 48][ring + 1] * cos(2 * pi() * k / n), 4) AS x, round(50 + [18, 34, 48][ring + 1] * sin(2 * pi() * k / n), 4) AS y FROM p")
def layout_ring(spark, sf):
    return plain(graph.ring_layout(*near_graph(spark, sf)))


# --- models

@query("WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem) SELECT round((l_quantity - m) / s, 6) AS z, count(*) AS n FROM lineitem, s GROUP BY 1")
def ml_scale(spark, sf):
    z = ml.standardize(scan_table(spark, sf, "lineitem", ["l_quantity"]), ["l_quantity"])
    return z.select(F.round("l_quantity", 6).alias("z")).groupBy("z").agg(F.count("*").alias("n"))


def predictions(spark, sf):
    """Lines, whether they were sold in a late year, and a guess from their group."""
    return items(spark, sf).select((F.col("year") >= 1998).cast("int").alias("y"), (F.col("flag") == "N").cast("int").alias("prediction"), F.col("l_quantity").alias("score"), F.when(F.col("l_linenumber") <= 3, "train").otherwise("test").alias("split"), "flag", "l_linestatus")


PRED = f"(SELECT (year >= 1998)::INT AS y, (flag = 'N')::INT AS p, l_quantity AS score, CASE WHEN l_linenumber <= 3 THEN 'train' ELSE 'test' END AS split, flag, l_linestatus FROM {ITEMS})"


@query(f"SELECT count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y = 0) AS negatives, count(*) AS n FROM {PRED}")
def ml_target(spark, sf):
    return predictions(spark, sf).agg(F.count_if(F.col("y") == 1).alias("positives"), F.count_if(F.col("y") == 0).alias("negatives"), F.count("*").alias("n"))


@query(f"SELECT g.y::BIGINT AS y, g.p::BIGINT AS predicted, count(x.y) AS n FROM (SELECT * FROM (VALUES (0), (1)) a(y), (VALUES (0), (1)) b(p)) g LEFT JOIN {PRED} x ON x.y = g.y AND x.p = g.p GROUP BY ALL")
def ml_confusion(spark, sf):
    return plain(ml.confusion(predictions(spark, sf)))


@query(f"WITH c AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (WHERE y = 1 AND p = 0)::DOUBLE AS fn, count(*) FILTER (WHERE y = 0 AND p = 0)::DOUBLE AS tn FROM {PRED}) SELECT round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 4) AS balanced_accuracy FROM c")
def ml_metrics(spark, sf):
    return ml.measures(predictions(spark, sf))


@query(f"WITH s AS (SELECT score, sum(y) AS p, sum(1 - y) AS q FROM {PRED} GROUP BY score), b AS (SELECT *, coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s) SELECT round(sum(p * (below + q / 2.0)) / (sum(p) * sum(q)), 6)::DOUBLE AS auc FROM b")
def ml_auc(spark, sf):
    return plain(ml.auc(predictions(spark, sf)))


@query(f"WITH s AS (SELECT score, sum(y) AS p, sum(1 - y) AS q FROM {PRED} GROUP BY score), r AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS k, sum(p) OVER (ORDER BY score DESC) AS tp, sum(q) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS ap, sum(q) OVER () AS aq, count(*) OVER () AS n FROM s) SELECT score AS threshold, round(fp / aq, 4)::DOUBLE AS fpr, round(tp / ap, 4)::DOUBLE AS tpr FROM r WHERE (k - 1) % greatest(n // 60, 1) = 0 OR k = n")
def roc_downsample(spark, sf):
    return plain(ml.roc_points(predictions(spark, sf)))


@query(f"SELECT split, count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y = 0) AS negatives FROM {PRED} GROUP BY split")
def ml_class_balance(spark, sf):
    return ml.class_balance(predictions(spark, sf))


@query(f"WITH c AS (SELECT flag, l_linestatus, count(*) AS n FROM {PRED} GROUP BY ALL), b AS (SELECT sum(n * (n - 1) / 2.0) AS b, sum(n) AS n FROM c), x AS (SELECT sum(n * (n - 1) / 2.0) AS a FROM (SELECT sum(n) AS n FROM c GROUP BY flag)), y AS (SELECT sum(n * (n - 1) / 2.0) AS d FROM (SELECT sum(n) AS n FROM c GROUP BY l_linestatus)) SELECT round((b - a * d / (n * (n - 1) / 2.0)) / ((a + d) / 2 - a * d / (n * (n - 1) / 2.0)), 6) AS ari FROM b, x, y")
def ml_ari(spark, sf):
    return plain(ml.adjusted_rand(predictions(spark, sf), "flag", "l_linestatus"))


def vectors(spark, sf):
    """Embeddings as vectors of all their numbers, standardised."""
    return ml.scaled_vectors(table(spark, sf, "embeddings"), "embedding").select("vec_id", "label", "features")


@query()
def ml_kmeans(spark, sf):
    df = vectors(spark, sf)
    df = graph.kept(df)
    return ml.by_size(ml.kmeans(df, 5).transform(df)).select("vec_id", "cluster")


@query("WITH m AS (SELECT *, avg(l_quantity) OVER w AS a, avg(l_discount) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)) SELECT round(sum(pow(l_quantity - a, 2) + pow(l_discount - b, 2)), 4) AS inertia FROM m")
def ml_inertia(spark, sf):
    return ml.inertia(items(spark, sf), ["l_quantity", "l_discount"], "flag")


def silhouette_sql(distance: str) -> str:
    """The mean silhouette of the given labels by a distance of the vectors a.v and b.v."""
    return f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT label, count(*) AS n FROM v GROUP BY label), d AS (SELECT a.vec_id, a.label, b.label AS other, sum({distance}) AS s FROM v a, v b GROUP BY ALL),
 m AS (SELECT vec_id, d.label, other, CASE WHEN d.label = other THEN s / nullif(n - 1, 0) ELSE s / n END AS m FROM d JOIN n ON other = n.label), x AS (SELECT vec_id, max(m) FILTER (WHERE label = other) AS a, min(m) FILTER (WHERE label <> other) AS b FROM m GROUP BY vec_id)
SELECT round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette FROM x"""


def given_clusters(spark, sf):
    """Embeddings, not scaled, in the clusters that their labels name."""
    return table(spark, sf, "embeddings").select(ml.array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").alias("prediction"))


@query(silhouette_sql("list_distance(a.v, b.v)"))
def ml_silhouette(spark, sf):
    """How well the given labels part the vectors, by exact Euclidean distances of all of them."""
    return ml.silhouettes(given_clusters(spark, sf)).agg(F.round(F.avg("silhouette"), 6).alias("silhouette"))


@query(silhouette_sql("pow(list_distance(a.v, b.v), 2)"))
def ml_silhouette_squared(spark, sf):
    return spark.createDataFrame([(round(ml.silhouette(given_clusters(spark, sf)), 6),)], "silhouette double")


@query()
def ml_silhouette_fitted(spark, sf):
    df = vectors(spark, sf)
    df = graph.kept(df)
    model = ml.kmeans(df, 5, 1)
    return spark.createDataFrame([(5, ml.silhouette(model.transform(df), distance="euclidean"))], "k long, silhouette double")


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '|42'), o_orderkey) <= (SELECT count(*) - ceil(0.3 * count(*)) FROM orders) THEN 'train' ELSE 'test' END AS split FROM orders")
def ml_split(spark, sf):
    """Seven in ten orders to learn from, to the row."""
    return ml.split(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query()
def ml_importance(spark, sf):
    t = items(spark, sf).select((F.col("year") >= 1998).cast("int").alias("y"), *MEASURES)
    model = ml.classifiers(1)["random_forest"].fit(ml.assemble(t, MEASURES))
    return ml.importances(model, MEASURES, spark)


@query()
def ml_elbow(spark, sf):
    df = vectors(spark, sf)
    return ml.elbow(ml.sweep(graph.kept(df), range(2, 11)))


@query()
def ml_best_k(spark, sf):
    df = vectors(spark, sf)
    return ml.best_k(ml.sweep(graph.kept(df), range(2, 9)))


@query()
def ml_pca2(spark, sf):
    df = vectors(spark, sf)
    return ml.pca2(df)[0].select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def learnable(spark, sf) -> DataFrame:
    """Lines dealt to train and test, written once, with whether a line was sold in a late year."""
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    t = items(spark, sf).select((F.col("year") >= 1998).cast("int").alias("y"), *MEASURES, *ids)
    return ml.assemble(graph.kept(ml.split(t, ids).drop(*ids)), MEASURES)


def fitted(t: DataFrame, name: str) -> DataFrame:
    """Measures of one of the models, on lines that it has not seen."""
    train = ml.require_classes(t.where("split = 'train'"))
    model = ml.classifiers(train.count())[name].fit(train)
    return ml.measures(model.transform(t.where("split = 'test'"))).withColumn("model", F.lit(name))


@query()
def ml_decision_tree(spark, sf):
    return fitted(learnable(spark, sf), "decision_tree")


@query()
def ml_random_forest(spark, sf):
    return fitted(learnable(spark, sf), "random_forest")


@query()
def ml_logreg(spark, sf):
    return fitted(learnable(spark, sf), "logistic")


@query()
def ml_compare(spark, sf):
    """The measures of all three models, and which is best by F1."""
    t = learnable(spark, sf)
    return ml.compared([fitted(t, name) for name in ("decision_tree", "logistic", "random_forest")])


@query()
def ml_ward(spark, sf):
    """All vectors, whole, in five clusters of Ward's method over centres."""
    return ml.ward_all(graph.kept(vectors(spark, sf)), 5).select("vec_id", "cluster")


def vector_tree(spark, sf):
    """Ward's tree over all vectors, by all of their numbers."""
    return dendrogram.ward_tree(table(spark, sf, "embeddings"), "vec_id", "embedding")


@query()
def win_leaf_position(spark, sf):
    """Merges and leaves of Ward's tree over all vectors, whole, with their places in the drawing."""
    return dendrogram.drawn(vector_tree(spark, sf)).withColumn("height", F.round("height", 6))


@query()
def ml_ward_cut(spark, sf):
    """All vectors in the five clusters that Ward's tree of all of them leaves when its highest merges are undone."""
    return dendrogram.cut(vector_tree(spark, sf), 5).withColumnRenamed("leaf", "vec_id")


@query()
def eda_iforest(spark, sf):
    return ml.isolation_forest(table(spark, sf, "events"), ["value", "user_id"], ["event_id"]).select("event_id", F.round("score", 6).alias("score"), "anomaly")


# --- documents, layout, runs

@query("SELECT 'first' AS query, count(*) FILTER (WHERE turn = 0) AS n FROM conversations UNION ALL SELECT 'user', count(*) FILTER (WHERE role = 'user') FROM conversations UNION ALL SELECT 'long', count(*) FILTER (WHERE length(text) > 200) FROM conversations UNION ALL SELECT 'early user', count(*) FILTER (WHERE turn < 2 AND role = 'user') FROM conversations UNION ALL SELECT 'tagged', count(*) FILTER (WHERE list_contains([role, 'x'], 'user')) FROM conversations")
def doc_queries(spark, sf):
    nested = table(spark, sf, "conversations").select(F.struct("turn", "role", F.struct(F.length("text").alias("size")).alias("body"), F.array("role", F.lit("x")).alias("tags")).alias("doc"))
    d = F.col("doc")
    return docs.count_matches(nested, {"first": d.turn == 0, "user": d.role == "user", "long": d.body.size > 200, "early user": (d.turn < 2) & (d.role == "user"), "tagged": F.array_contains(d.tags, "user")})


@query("SELECT role AS key, count(*) AS n, count(DISTINCT conv_id) AS parts, round(avg(length(text)), 4) AS avg_size FROM conversations GROUP BY role")
def doc_groups(spark, sf):
    return docs.group_sizes(table(spark, sf, "conversations"), F.col("role"), F.col("conv_id"), F.length("text"))


@query("SELECT 'turn' AS path, 'bigint' AS type, min(turn::VARCHAR) AS sample FROM conversations UNION ALL SELECT 'body.role', 'string', min(role) FROM conversations UNION ALL SELECT 'body.size', 'int', min(length(text)::VARCHAR) FROM conversations UNION ALL SELECT 'tags', 'array<string>', min('[\"' || role || '\",\"x\"]') FROM conversations")
def json_flatten(spark, sf):
    return docs.leaf_samples(table(spark, sf, "conversations").select("turn", F.struct("role", F.length("text").alias("size")).alias("body"), F.array("role", F.lit("x")).alias("tags")))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.none.x'), 'none') AS absent FROM events")
def json_path(spark, sf):
    return table(spark, sf, "events").select("event_id", docs.json_path("props", "k").alias("k"), docs.json_path("props", "none.x", "none").alias("absent"))


@query("WITH s AS (SELECT length(to_json({'conv_id': conv_id, 'turn': turn, 'role': role, 'text': text})::VARCHAR) AS n FROM conversations) SELECT count(*) AS n, round(avg(n), 2) AS avg_size, sum(n)::BIGINT AS total_size FROM s")
def doc_stats(spark, sf):
    return docs.statistics(table(spark, sf, "conversations"))


@query("SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, length(text)::BIGINT AS size FROM conversations")
def src_doc_json(spark, sf):
    """Conversations written as JSON documents and read back."""
    t = table(spark, sf, "conversations")
    back = to_json(t).select(F.from_json("json", t.schema).alias("d")).select("d.*")
    return plain(back.select("conv_id", "turn", "role", F.length("text").alias("size")))


@query("SELECT to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey, 'c_acctbal': c_acctbal, 'c_mktsegment': c_mktsegment})::VARCHAR AS json FROM customer")
def sink_json(spark, sf):
    return to_json(table(spark, sf, "customer"))


OPEN = {"customer": "customer", "event": "events", "line": "lineitem"}


def open_texts(spark, sf):
    """Documents of three shapes in one table: customers with a list and an object, events with their own properties and
    lines with numbers."""
    one = lambda name, *fields: table(spark, sf, OPEN[name]).select(F.to_json(F.struct(F.lit(name).alias("kind"), *fields)).alias("json"))
    customers = one("customer", F.col("c_custkey").alias("id"), F.array("c_mktsegment", "c_name").alias("tags"), F.struct(F.col("c_nationkey").alias("nation"), F.struct(F.col("c_name").alias("name")).alias("who")).alias("at"))
    events = table(spark, sf, "events").select(F.concat(F.lit('{"kind":"event","id":"e'), F.col("event_id"), F.lit('","props":'), F.col("props"), F.lit("}")).alias("json"))
    lines = one("line", F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("at"))
    return customers.unionByName(events).unionByName(lines)


@query("SELECT '$.kind' AS path, 'STRING' AS type, (SELECT count(*) FROM customer) + (SELECT count(*) FROM events) + (SELECT count(*) FROM lineitem) AS n, (SELECT count(*) FROM customer) + (SELECT count(*) FROM events) + (SELECT count(*) FROM lineitem) AS documents, 'customer' AS sample UNION ALL SELECT '$.id', 'BIGINT', count(*), count(*), min(id::VARCHAR) FROM (SELECT c_custkey AS id FROM customer UNION ALL SELECT l_orderkey FROM lineitem) UNION ALL SELECT '$.id', 'STRING', count(*), count(*), min('e' || event_id) FROM events UNION ALL SELECT '$.tags[]', 'STRING', 2 * count(*), count(*), min(least(c_mktsegment, c_name)) FROM customer UNION ALL SELECT '$.at.nation', 'BIGINT', count(*), count(*), min(c_nationkey::VARCHAR) FROM customer UNION ALL SELECT '$.at.who.name', 'STRING', count(*), count(*), min(c_name) FROM customer UNION ALL SELECT '$.props.k', 'BIGINT', count(*), count(*), min(json_extract_string(props, '$.k')) FROM events UNION ALL SELECT '$.at', 'BIGINT', count(*), count(*), min(l_linenumber::VARCHAR) FROM lineitem")
def variant_leaves(spark, sf):
    """Paths and types of all leaves of documents of differing shapes."""
    return variants.leaf_summary(open_texts(spark, sf).select(variants.as_variant("json").alias("doc")), "doc")


@query("SELECT 'customer' AS kind, count(*) AS n, sum(c_nationkey)::BIGINT AS nations, NULL::BIGINT AS k, min(c_name) AS tag FROM customer UNION ALL SELECT 'event', count(*), NULL, sum(json_extract(props, '$.k')::BIGINT)::BIGINT, NULL FROM events UNION ALL SELECT 'line', count(*), NULL, NULL, NULL FROM lineitem")
def variant_paths(spark, sf):
    """Numbers and texts at paths that only some of the documents have."""
    doc = open_texts(spark, sf).select(variants.as_variant("json").alias("doc"))
    read = doc.select(variants.at("doc", "kind", "string").alias("kind"), variants.at("doc", "at.nation", "bigint").alias("nation"), variants.at("doc", "props.k", "bigint").alias("k"), variants.at("doc", "tags.1", "string").alias("tag"))
    return read.groupBy("kind").agg(F.count("*").alias("n"), F.sum("nation").alias("nations"), F.sum("k").alias("k"), F.min("tag").alias("tag"))


def shelf(spark) -> str:
    """A new folder beside the checkpoints, which all machines share."""
    return f"{shared_folder(spark)}/store_{uuid.uuid4().hex}"


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'NEAR' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer WHERE c_acctbal >= 0 ORDER BY c_custkey DESC")
def doc_store(spark, sf):
    """Customers as documents of a store: added in two parts, some changed, some dropped, the rest found, newest first."""
    at, t = shelf(spark), table(spark, sf, "customer")
    for part in (0, 1):
        documents.append(t.where(F.col("c_custkey") % 2 == part), f"{at}/1")
    documents.change(spark, f"{at}/1", f"{at}/2", t.schema, F.col("c_nationkey") < 5, {"c_mktsegment": F.lit("NEAR")})
    documents.drop(spark, f"{at}/2", f"{at}/3", t.schema, F.col("c_acctbal") < 0)
    return documents.find(spark, f"{at}/3", t.schema, order=["c_custkey"]).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT year(o_orderdate)::BIGINT AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) IN (SELECT year(o_orderdate) FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2) GROUP BY 1")
def sink_tracks(spark, sf):
    """Orders written by year; of the folders only those of the two years with the most urgent orders are read back."""
    at = shelf(spark)
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    save_items(orders, at, by="year", columns=["o_orderkey", "o_totalprice", "o_orderpriority", "year"])
    urgent = relational.count_by(orders.where(F.col("o_orderpriority").startswith("1")), ["year"])
    back = read_items(spark, at, by="year", values=relational.top_n(urgent, "n", 2, ["year"]), columns=["o_totalprice"])
    return plain(back.groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")))


@query()
def run_pipeline(spark, sf):
    """The stages of a whole run over the lines, each with its outcome."""
    t = items(spark, sf).select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("id"), F.col("l_returnflag").alias("name"), "year", *MEASURES)
    config = pipeline.RunConfig(k=3, year_from=1990, year_to=2005, features=tuple(MEASURES), known=tuple(MEASURES), late_year=1998)
    return pipeline.run(t, config).summary(spark)
