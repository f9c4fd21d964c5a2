"""Benchmark passages in documents, in DataFrame functions alone.

Every window of an item's size that could be like the item is compared with it. A window that is must share shingles of
at least the similarity's part of the item's weight, so the shingles that a document shares with an item say where its
windows can lie, and a sum over them rules most out. The others get a SimHash fingerprint, each word voting with its
length; those within RADIUS bits of the item's are verified by exact weighted-shingle similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, checkpointed

#: Bits of a fingerprint that may differ, of 128: a passage at 0.8 differs in some 20, an unrelated one in some 64.
RADIUS = 48
#: Votes are summed four to a number, so windows of more characters are verified without a fingerprint.
VOTES = (1 << 14) - 1
LOW, HIGH = 0x0001000100010001, 0x4000400040004000
SEEDS = (17, 4242)
#: Most rows of benchmark shingles that are broadcast (24 bytes of key, item and weight each), and most shared shingles of
#: documents with items; beyond it the joins shuffle.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def run_hashes(words: Column, size: int) -> Column:
    """Hash of each run of so many words, by its first word's place; empty where there are too few words."""
    at = lambda i, k: F.get(words, i + k)
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, *[at(i, k) for k in range(1, size)]))
    return F.slice(hashes, 1, F.greatest(F.size(words) - size + 1, F.lit(0)))


def weighted_shingles(words: Column) -> Column:
    """Distinct shingles of up to five words with their weights: the number of characters in them."""
    def of(size: int) -> Column:
        at = lambda i, k: F.get(words, i + k)
        both = F.transform(words, lambda w, i: F.struct(F.xxhash64(w, *[at(i, k) for k in range(1, size)]).alias("h"), sum((F.length(at(i, k)) for k in range(1, size)), F.length(w)).alias("w")))
        return F.array_distinct(F.slice(both, 1, F.greatest(F.size(words) - size + 1, F.lit(0))))

    short = F.when(F.size(words) < 2, of(1))
    for size in range(2, SHINGLE_WORDS):
        short = short.when(F.size(words) == size, of(size))
    return short.otherwise(of(SHINGLE_WORDS))


def total_weight(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0), lambda acc, s: acc + s["w"])


def votes_of(words: Column, seed: int) -> Column:
    """A hash and the number of characters of each word."""
    return F.transform(words, lambda w: F.struct(F.xxhash64(w, F.lit(seed)).alias("h"), F.length(w).cast("long").alias("n")))


def lanes_of(votes: Column, bit: int) -> Column:
    """The votes for four bits, 16 apart, side by side in one number."""
    return F.aggregate(votes, F.lit(0).cast("long"), lambda acc, v: acc + F.shiftrightunsigned(v["h"], bit).bitwiseAND(F.lit(LOW)) * v["n"])


def fingerprint(words: Column) -> Column:
    """SimHash of 128 bits as two numbers: each bit is what the words that have it set hold of all characters, over half.
    Null for windows of more characters than VOTES."""
    total = F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + F.length(w))
    short = F.when(total <= VOTES, words)
    half, prints = F.when(total <= VOTES, (VOTES - F.floor(total / 2)) * F.lit(LOW)), []
    for seed in SEEDS:
        votes, own = votes_of(short, seed), F.lit(0).cast("long")
        for bit in range(16):
            over = (lanes_of(votes, bit) + half).bitwiseAND(F.lit(HIGH))
            own = own.bitwiseOR(F.shiftleft(F.shiftrightunsigned(over, 14), bit))
        prints.append(own)
    return F.when(total <= VOTES, F.array(*prints))


def run_structs(words: Column, size: int) -> Column:
    """Runs of so many words, with their size and place."""
    return F.transform(run_hashes(words, size), lambda h, i: F.struct(F.lit(size).alias("k"), i.alias("at"), h.alias("h")))


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ; null if one is missing."""
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def benchmark_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, size, k, item_shingles, item_weight, item_print) of the items that have words."""
    rows = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    rows = rows.select("item_id", F.size("words").alias("size"), F.least(F.size("words"), F.lit(SHINGLE_WORDS)).alias("k"), weighted_shingles(F.col("words")).alias("item_shingles"), fingerprint(F.col("words")).alias("item_print"))
    return checkpointed(rows.withColumn("item_weight", total_weight(F.col("item_shingles")))).withColumn("item", F.monotonically_increasing_id())


def likely_windows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(id, item, size, low, high): where in documents windows of an item's size begin whose shared shingles weigh enough.

    A shared shingle counts for the windows that begin up to the item's length before it: its weight comes in at the first
    of them and goes out behind the last, so one pass of running sums over these places, in order, weighs all windows of a
    document, however often a shingle repeats in it."""
    table = items.select("item", "size", "k", "item_weight", F.explode("item_shingles").alias("s")).select("item", "size", "k", "item_weight", F.col("s.h").alias("h"), F.col("s.w").alias("w"))
    table = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
    sizes = sorted(r.k for r in items.select("k").distinct().collect()) or [SHINGLE_WORDS]  # five at most
    runs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    if len(sizes) == 1:
        runs = runs.select("id", F.lit(sizes[0]).alias("k"), F.posexplode(run_hashes(F.col("words"), sizes[0])).alias("at", "h"))
    else:
        told = F.flatten(F.array(*[run_structs(F.col("words"), k) for k in sizes]))
        runs = runs.select("id", F.explode(told).alias("r")).select("id", "r.*")
    comes = F.struct((F.col("at") - F.col("size") + F.col("k")).alias("low"), F.col("w").cast("long").alias("by"))
    goes = F.struct((F.col("at") + 1).alias("low"), (-F.col("w")).cast("long").alias("by"))
    steps = runs.join(table, ["h", "k"]).select("id", "item", "size", "item_weight", F.explode(F.array(comes, goes)).alias("x"))
    sums = steps.groupBy("id", "item", "size", "item_weight", F.col("x.low").alias("low")).agg(F.sum("x.by").alias("by"))
    order = Window.partitionBy("id", "item").orderBy("low")
    held = sums.withColumn("held", F.sum("by").over(order)).withColumn("high", F.lead("low").over(order) - 1)
    return held.where((F.col("held") >= similarity * F.col("item_weight") - 1e-9) & F.col("high").isNotNull()).select("id", "item", "size", "low", "high")


def windows(docs: DataFrame, likely: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, item, start, words): the likely windows of each document. One that is shorter than the item is one window."""
    many = likely.count()
    by_id = likely.groupBy("id").agg(F.collect_list(F.struct("item", "size", "low", "high")).alias("likely"))  # as many as the document's places at the most, for each item that it holds
    whole = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(by_id) if many <= BROADCAST_ROWS else by_id, "id")
    laid = whole.select("id", words_of(F.col("text")).alias("all"), "likely").withColumn("s", F.explode("likely")).select("id", "all", "s.*")
    first, last = F.greatest("low", F.lit(0)), F.least(F.col("high"), F.greatest(F.size("all") - F.col("size"), F.lit(0)))
    laid = laid.where(first <= last).select("id", "all", "size", "item", F.explode(F.sequence(first, last)).alias("start"))
    return laid.select("id", "item", "start", F.slice("all", F.col("start") + 1, F.col("size")).alias("words"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row for each document and benchmark item that it holds: id, item_id, similarity, start and n_words of the
    window that is most like the item (the first of equals).

    Documents without a leak have no row. Null texts, texts without words, null ids and items without words match
    nothing; rows of equal id count as one document, rows of equal item_id as one item; an empty table on either side
    gives no rows. Other columns of both tables aren't read, so their names may clash."""
    items = benchmark_items(benchmark, item_col, item_text_col)
    likely = checkpointed(likely_windows(docs, items, id_col, text_col, similarity))
    few = items.agg(F.sum(F.size("item_shingles"))).first()[0] or 0
    known = items.select("item", "item_id", "size", "item_shingles", "item_weight", "item_print")
    known = F.broadcast(known) if few <= BROADCAST_ROWS else known
    laid = windows(docs, likely, id_col, text_col).dropDuplicates(["id", "item", "start", "words"]).withColumn("print", fingerprint(F.col("words")))
    near = laid.join(known, "item").where(F.coalesce(distance(F.col("print"), F.col("item_print")) <= radius, F.lit(True)))
    both = near.withColumn("shingles", weighted_shingles(F.col("words")))
    common = total_weight(F.array_intersect("shingles", "item_shingles"))
    both = both.select("id", "item_id", "start", "size", common.alias("common"), (total_weight(F.col("shingles")) + F.col("item_weight")).alias("total"))
    both = both.select("id", "item_id", "start", "size", (F.col("common") / (F.col("total") - F.col("common"))).alias("similarity"))
    best = both.where(F.col("similarity") >= similarity).groupBy("id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("minus"), "size")).alias("best"))
    return best.select(F.col("id").alias(id_col), "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.minus")).alias("start"), F.col("best.size").alias("n_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns; documents without an id stay. Texts are only
    moved if the ids that go are too many to broadcast."""
    gone = checkpointed(find_leaks(docs, benchmark, id_col=id_col, **options).select(id_col).distinct())
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti")
