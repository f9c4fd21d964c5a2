"""Near copies by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles of five words weigh their count times 1 + ln(N / df), df counted over all documents: each batch of
documents sends its distinct shingles, with how many of its documents hold them, to the bucket of their hash, and the
bucket sends back their document frequencies. Samples are banded into bucket keys; texts that meet in a bucket are
candidates, and exact weighted Jaccard similarity decides. Crowded buckets are dealt anew by longer bands, twice, and in
all crowded buckets of longer bands every member meets a few central ones. Linked texts form classes, found by star
contraction of the links. What crowds may still hide is then looked up exactly: of the members of crowded buckets with more
than one class, those of different classes meet that share a shingle of their prefixes, as all pairs of the similarity do.

What the copies of a large group share is frequent because of them, so their weights alone tell them apart. By counts, too,
texts can be near copies: candidates may then have the similarity by weights or by counts, and the members of a crowded
bucket with more than one class all meet across its classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, Shelf, Words, bound_batches, checkpointed, finish, join_by_hot_keys

#: Bands and samples a band: for all texts, for those in crowded buckets, and for those in buckets that are crowded then.
TIERS = [(12, 3), (24, 7), (96, 14)]
#: Members from which a bucket is crowded, and central members that each member of one meets.
CROWD, LEADERS = 24, 4
#: Texts that share a shingle up to which all their pairs are rows, and texts of either side of a tile where more meet.
FEW_TEXTS, LIST_ROWS = 24, 1_000
#: Shingles at once by which the texts of a tile are compared by counts.
TILE_SHINGLES = 4_096
#: Shingles of the documents that share a batch, and bytes of shingles that share a bucket where they are counted.
BATCH_SHINGLES, BUCKET_BYTES = 1 << 20, 8 << 20
#: Bytes of text in one file of the shingles, about.
FILE_BYTES = 16 << 20
#: Most documents whose shingles are broadcast to the pairs that they are in, and most bytes of the shingles of one.
HOT_VECTORS, HOT_BYTES = 500, 1 << 17
#: Most ids that are broadcast to pick documents by; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Links of one id from which it may count as hot.
HOT_LINKS = 200
MULTIPLIER = 0x5851F42D4C957F2D


def shingles(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as sorted 64-bit hashes, and their counts. A text of fewer words is one shingle; none has none."""
    w = words.of(text)[0]
    if not len(w):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = max(1, len(w) - SHINGLE_WORDS + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE_WORDS, len(w))):
        h = h * np.uint64(MULTIPLIER) + w[k : k + n]
    return np.unique(finish(h), return_counts=True)


class Sampler:
    """Improved consistent weighted sampling. The random numbers of a shingle in a sample come from a table by its hash."""

    SIZE = 1 << 16

    def __init__(self, samples: int, seed: int):
        rng = np.random.default_rng(seed)
        r, c = rng.gamma(2, 1, self.SIZE), rng.gamma(2, 1, self.SIZE)
        self.r, self.over_r, self.log_c, self.beta = (x.astype(np.float32) for x in (r, 1 / r, np.log(c), rng.random(self.SIZE)))
        self.turn = rng.integers(1, 1 << 63, samples, np.uint64)[:, None] | np.uint64(1)

    def sample(self, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One 64-bit number for each sample: the shingle and the step of its weight that were drawn."""
        log_w, best, drawn = np.log(weight), None, None
        room = max(64, (1 << 18) // len(self.turn))
        for at in range(0, len(h), room):
            part = h[at : at + room]
            slot = ((part[None, :] * self.turn) >> np.uint64(48)).astype(np.int64)
            r = self.r[slot]
            step = np.floor(log_w[None, at : at + room] * self.over_r[slot] + self.beta[slot])
            low = self.log_c[slot] - r * (step - self.beta[slot] + np.float32(1))
            k = low.argmin(1)[:, None]
            least = np.take_along_axis(low, k, 1)[:, 0]
            own = finish(part[k[:, 0]] + np.take_along_axis(step, k, 1)[:, 0].astype(np.int64).view(np.uint64) * np.uint64(MULTIPLIER))
            if best is None:
                best, drawn = least, own
            else:
                drawn, best = np.where(least < best, own, drawn), np.minimum(least, best)
        return drawn


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        h = finish(h * np.uint64(MULTIPLIER) + samples.reshape(bands, rows)[:, k])
    return h.view(np.int64)


def signature(h: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
    """Two hashes of the shingles and their counts."""
    seen = finish(h * np.uint64(MULTIPLIER) + counts.astype(np.uint64))
    return int(seen.sum(dtype=np.uint64).view(np.int64)), int(finish(seen * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64))


def shingle_table(texts: DataFrame) -> DataFrame:
    """(batch, id, one, two, n, h, c): each text's signature, number of shingles, shingles and counts, and its batch.
    Texts without words have no row."""

    def run(batches):
        words, batch, room = Words(), TaskContext.get().partitionId() << 32, BATCH_SHINGLES
        for rows in batches:
            cols = [[] for _ in range(7)]
            for id_, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                h, c = shingles(text, words)
                if len(h):
                    if room < len(h):
                        batch, room = batch + 1, BATCH_SHINGLES
                    room -= len(h)
                    for col, x in zip(cols, (batch, id_, *signature(h, c), len(h), h.tobytes(), c.astype("<u4").tobytes())):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:5]), *(pa.array(x, pa.binary()) for x in cols[5:])], ["batch", "id", "one", "two", "n", "h", "c"])

    return texts.mapInArrow(run, "batch long, id long, one long, two long, n long, h binary, c binary")


def joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The numbers in all the rows of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def packed_gaps(h: np.ndarray, first: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Sorted hashes in parts that begin at first, as the gaps between them, the first from the part's start, each in as
    few bytes as the part's widest gap needs."""
    gaps = np.diff(h, prepend=np.uint64(0))
    gaps[first] = h[first] - starts
    raw = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)
    widths = [max(1, -(-int(widest).bit_length() // 8)) for widest in np.maximum.reduceat(gaps, first)]
    return [raw[a:b, :w].tobytes() for a, b, w in zip(first, [*first[1:], len(h)], widths)]


def unpacked_gaps(packed: bytes, n: int, start: int) -> np.ndarray:
    """The n hashes of a part that starts there."""
    raw = np.zeros((n, 8), np.uint8)
    raw[:, : len(packed) // n] = np.frombuffer(packed, np.uint8).reshape(n, -1)
    return np.cumsum(raw.view("<u8")[:, 0]) + np.uint64(start)


def document_frequencies(table: DataFrame, shingles_: int) -> DataFrame:
    """(batch, part, df): how many documents hold each distinct shingle of a batch, in the order of the shingles; the
    shingles are cut into parts by their first bits. A shingle that is in many documents comes once from each batch."""
    bits = max(8, (max(1, shingles_ * 8 // BUCKET_BYTES) - 1).bit_length())

    def split(batch: pa.Table) -> pa.Table:
        h, n = np.unique(joined(batch["h"], "<u8"), return_counts=True)
        part, first = np.unique(h >> np.uint64(64 - bits), return_index=True)
        ends = [*first[1:].tolist(), len(h)]
        n = n.astype("<u4")
        return pa.table({"part": part.astype(np.int64), "batch": np.full(len(part), batch["batch"][0].as_py()), "h": pa.array(packed_gaps(h, first, part << np.uint64(64 - bits)), pa.binary()), "n": pa.array([n[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())})

    def count(part: pa.Table) -> pa.Table:
        sizes = [len(x) // 4 for x in part["n"].to_pylist()]
        start = part["part"][0].as_py() << (64 - bits)
        _, back = np.unique(np.concatenate([unpacked_gaps(x, n, start) for x, n in zip(part["h"].to_pylist(), sizes)]), return_inverse=True)
        df = np.bincount(back, joined(part["n"], "<u4"))[back].astype("<u8")
        ends = np.cumsum(sizes).tolist()
        return pa.table({"batch": part["batch"], "part": part["part"], "df": pa.array([df[a:b].tobytes() for a, b in zip([0, *ends], ends)], pa.binary())})

    parts = table.select("batch", "h").groupBy("batch").applyInArrow(split, "part long, batch long, h binary, n binary")
    return parts.groupBy("part").applyInArrow(count, "batch long, part long, df binary")


def frequency_rank(df: np.ndarray) -> np.ndarray:
    """Document frequencies in steps of a quarter of their binary logarithm; 0 is that of one document."""
    return np.minimum(4 * np.log2(df.astype(float)), 255).astype(np.uint8)


def weighted(table: DataFrame, dfs: DataFrame, wanted: DataFrame, docs: int, files: int, make, schema: str) -> DataFrame:
    """What make(ids, shingles, counts, weights, ranks of their frequencies) gives for the wanted texts, (batch, id, one), batch by batch. The shingles stay
    where they are: only document frequencies and ids are sent to them."""
    picks = wanted.groupBy("batch").agg(F.collect_list("id").alias("ids"), F.collect_list("one").alias("ones"))  # as many as a batch holds
    none = lambda t: F.lit(None).cast(t)
    told = dfs.select("batch", "part", "df", none("array<long>").alias("ids"), none("array<long>").alias("ones")).unionByName(picks.select("batch", F.lit(-1).cast("long").alias("part"), none("binary").alias("df"), "ids", "ones"))

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("part")
        if not told.num_rows or told["part"][0].as_py() >= 0:  # no text of this batch is wanted
            return make([], [], [], [], [])
        left = set(zip(told["ids"][0].as_py(), told["ones"][0].as_py()))
        h = joined(texts["h"], "<u8")
        _, place = np.unique(h, return_inverse=True)
        df, c = joined(told["df"].slice(1), "<u8"), joined(texts["c"], "<u4")
        w = (1 + np.log(docs / df)).astype(np.float32)[place] * c.astype(np.float32)
        rank = frequency_rank(df)[place]
        ids, vectors, counts, weights, ranks, at = [], [], [], [], [], 0
        for id_, one, n in zip(*(texts[k].to_pylist() for k in ("id", "one", "n"))):
            if (id_, one) in left:
                left.remove((id_, one))
                ids.append(id_)
                vectors.append(h[at : at + n])
                counts.append(c[at : at + n])
                weights.append(w[at : at + n])
                ranks.append(rank[at : at + n])
            at += n
        return make(ids, vectors, counts, weights, ranks)

    sides = table.select("batch", "id", "one", "n", "h", "c").groupBy("batch"), told.repartition(files, "batch").groupBy("batch")
    return sides[0].cogroup(sides[1]).applyInArrow(run, schema)


def keys_of(vectors, weights, tier: int) -> list[list[int]]:
    bands, rows = TIERS[tier]
    sampler = Sampler(bands * rows, tier + 1)
    return [band_keys(sampler.sample(h, w), bands, rows).tolist() for h, w in zip(vectors, weights)]


def band_maker(ids, vectors, counts, weights, ranks) -> pa.Table:
    totals, sizes = [float(w.sum(dtype=float)) for w in weights], [int(c.sum(dtype=np.int64)) for c in counts]
    return pa.table({"id": pa.array(ids, pa.int64()), "total": pa.array(totals, pa.float64()), "size": pa.array(sizes, pa.int64()), "keys": pa.array(keys_of(vectors, weights, 0) if ids else [], pa.list_(pa.int64()))})


def band_keys_of(tier: int):
    def run(batches):
        for batch in batches:
            sides = ([np.frombuffer(x, kind) for x in batch.column(k).to_pylist()] for k, kind in ((1, "<u8"), (2, "<f4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), pa.array(keys_of(*sides, tier), pa.list_(pa.int64()))], ["id", "total", "size", "keys"])

    return run


def vector_maker(ids, vectors, counts, weights, ranks) -> pa.Table:
    return pa.table({"id": pa.array(ids, pa.int64())} | {name: pa.array([x.tobytes() for x in column], pa.binary()) for name, column in (("h", vectors), ("c", counts), ("w", weights), ("r", ranks))})


def small_pairs(members: DataFrame, least: float, counts: bool = False) -> DataFrame:
    """All pairs (a < b) of the members of buckets that aren't crowded, but those whose weights differ too much for the
    similarity; members: (key, id, total, size, n)."""
    groups = members.where(F.col("n") <= CROWD).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("id", "total", "size"))).alias("texts"))
    firsts = groups.select("texts", F.posexplode("texts").alias("k", "a"))
    both = firsts.select("a", F.explode(F.slice("texts", F.col("k") + 2, F.lit(CROWD))).alias("b"))
    return both.where(alike("a.", "b.", least, counts)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def alike(a: str, b: str, least: float, counts: bool) -> Column:
    """Whether texts of these total weights, or of these numbers of shingles if counts decide too, can have the similarity:
    what they share is at most the smaller one. The slack is for rounding."""
    can = lambda x: F.least(a + x, b + x) >= (least - 1e-5) * F.greatest(a + x, b + x)
    return can("total") | can("size") if counts else can("total")


def bucket_members(signed: DataFrame) -> DataFrame:
    """(key, id, total, size, n) for the buckets with two texts or more. Rows are small; adaptive plans split a crowded bucket's."""
    keys = signed.select("id", "total", "size", F.explode(F.array_distinct("keys")).alias("key"))
    return checkpointed(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))


def leader_pairs(members: DataFrame, least: float, counts: bool = False) -> DataFrame:
    """Pairs of each member of a crowded bucket with its central ones: those that share most buckets with others."""
    crowded = members.where(F.col("n") > CROWD)
    weight = crowded.groupBy("id").agg(F.sum("n").alias("central"))
    told = crowded.join(weight, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(LEADERS)))
    heads = told.groupBy("key", "part").agg(F.max(F.struct("central", (-F.col("id")).alias("minus"), "total", "size")).alias("top"))
    met = crowded.select("key", "id", "total", "size").join(heads.select("key", (-F.col("top.minus")).alias("lead"), F.col("top.total").alias("_total"), F.col("top.size").alias("_size")), "key")
    met = met.where((F.col("id") != F.col("lead")) & alike("", "_", least, counts))
    return met.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))


def linked_classes(links: DataFrame) -> DataFrame:
    """(id, class) for all ids in links (a < b): the smallest id that links lead to, by large and small star steps. The
    links of an id that has many of them stay where they are and get its smallest neighbour by broadcast."""
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(edges: DataFrame, small: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")) if small else both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        least = checkpointed(least)
        told = join_by_hot_keys(both, least, ["u"], "n", least=HOT_LINKS)
        if small:
            moved = told.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.where("u <> m").select(F.col("m").alias("a"), F.col("u").alias("b")))
        else:
            moved = told.where("v > u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        return checkpointed(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())

    edges = checkpointed(links.select("a", "b").distinct())
    before = sign(edges)
    while before[0]:
        edges = star(star(edges, False), True)
        after = sign(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("id"), F.col("a").alias("class")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("class"))).groupBy("id").agg(F.min("class").alias("class"))


def with_vectors(pairs: DataFrame, vectors: DataFrame, side: str, hot: DataFrame | None) -> DataFrame:
    """pairs with the shingles h, weights w and counts c of one side. What many pairs share comes by broadcast, so that no task gets
    all pairs of one document."""
    told = vectors.select(F.col("id").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in ("h", "w", "c")])
    if hot is None:
        return pairs.join(told, side)
    few = F.broadcast(hot.select(F.col("id").alias(side)))
    often = pairs.join(F.broadcast(told.join(few, side, "left_semi")), side)
    return often.unionByName(pairs.join(few, side, "left_anti").join(told, side))


def similarity_of(h_a: np.ndarray, w_a: np.ndarray, h_b: np.ndarray, w_b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts' shingles."""
    _, i, j = np.intersect1d(h_a, h_b, assume_unique=True, return_indices=True)
    common = np.minimum(w_a[i], w_b[j]).sum(dtype=float)
    return float(common / (w_a.sum(dtype=float) + w_b.sum(dtype=float) - common))


def verified(pairs: DataFrame, vectors: DataFrame, least: float, counts: bool = False) -> DataFrame:
    """The pairs whose weighted Jaccard similarity is at least that, with it; or that by counts, if those decide too and it
    is more. vectors has n, in how many pairs each is."""
    many = max(300, 2 * pairs.count() // HOT_VECTORS)  # all n add up to twice the pairs, so at most HOT_VECTORS are hot
    hot = vectors.where((F.col("n") > many) & (F.octet_length("h") <= HOT_BYTES)).select("id")
    hot = hot if hot.limit(1).count() else None
    both = with_vectors(with_vectors(pairs, vectors, "a", hot), vectors, "b", hot)

    def run(batches):
        for batch in batches:
            sims = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(2, 8))):
                h_a, w_a, c_a, h_b, w_b, c_b = (np.frombuffer(x, k) for x, k in zip(row, ("<u8", "<f4", "<u4") * 2))
                sim = similarity_of(h_a, w_a, h_b, w_b)
                sims.append(max(sim, similarity_of(h_a, c_a, h_b, c_b)) if counts and sim < least else sim)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    return both.select("a", "b", "h_a", "w_a", "c_a", "h_b", "w_b", "c_b").mapInArrow(run, "a long, b long, similarity double").where(F.col("similarity") >= least)


def prefix(h: np.ndarray, w: np.ndarray, rank: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The shingles that a text's prefix holds, the weight from each of them on, and the whole weight. Shingles stand in one
    order for all texts, the rare ones first. Two texts of the similarity share `least` of either weight, so the first
    shingle that they share has that much from there on in both; shingles of one document are shared with none."""
    order = np.lexsort((h, rank))
    left = np.cumsum(w[order][::-1], dtype=float)[::-1]
    inside = (left >= (least - 1e-5) * left[0]) & (rank[order] > 0)
    return h[order][inside].view(np.int64), left[inside], float(left[0])


def mixed_buckets(crowded: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, id, class, n): the members of crowded buckets, (key, id), that hold texts of more than one class, and how many
    members the bucket has."""
    told = checkpointed(crowded.join(classes, "id", "left").select("key", "id", F.coalesce("class", "id").alias("class")))
    mixed = told.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n")
    return checkpointed(told.join(mixed, "key"))


def elements(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A shingle that a text has several times as so many numbers, the first of them itself: what two texts have of them in
    common is the sum of the smaller counts."""
    e, nth = np.repeat(h, c), np.arange(c.sum(dtype=np.int64)) - np.repeat(np.cumsum(c, dtype=np.int64) - c, c)
    return np.where(nth > 0, finish(e + nth.astype(np.uint64) * np.uint64(MULTIPLIER)), e)


def in_common(texts: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many elements each of the texts at low has in common with each of those at high."""
    every, place = np.unique(np.concatenate(texts), return_inverse=True)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    often = np.bincount(place, minlength=len(every)) > 1
    shared = often[place]
    row, place = row[shared], (np.cumsum(often) - 1)[place[shared]]
    order = place.argsort(kind="stable")
    row, place = row[order], place[order]
    common = np.zeros((len(low), len(high)), np.float32)
    for at in range(0, int(often.sum()), TILE_SHINGLES):
        part = slice(*np.searchsorted(place, [at, at + TILE_SHINGLES]))
        held = np.zeros((len(texts), TILE_SHINGLES), np.float32)
        held[row[part], place[part] - at] = 1
        common += held[low] @ held[high].T
    return common


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """As few of the links (a, b) as hold together what all of them do."""
    top: dict[int, int] = {}
    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        ends = []
        for z in (x, y):
            while top.get(z, z) != z:
                top[z] = z = top.get(top[z], top[z])
            ends.append(z)
        if ends[0] != ends[1]:
            top[ends[0]] = ends[1]
            out.append((x, y))
    return out


def links_by_counts(mixed: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(a, b): links that hold together all classes of which two texts of one bucket have the similarity by counts. All
    members of a bucket (key, id, class, n) meet across its classes, in tiles of LIST_ROWS by LIST_ROWS."""
    blocks = F.ceil(F.col("n") / LIST_ROWS)
    told = vectors.join(if_few(checkpointed(mixed.select("id").distinct())), "id").select("id", "h", "c")
    dealt = mixed.withColumn("block", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    tiles = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "class").join(told, "id")

    def meet(tile: pa.Table) -> pa.Table:
        of, kind = tile["block"].to_numpy(), tile["class"].to_numpy()
        texts = [elements(np.frombuffer(h, "<u8"), np.frombuffer(c, "<u4")) for h, c in zip(tile["h"].to_pylist(), tile["c"].to_pylist())]
        size = np.array([len(x) for x in texts])
        known, n = np.unique(kind, return_counts=True)
        most = kind == known[n.argmax()]  # texts of one class need not meet
        low, high = of == tile["low"][0].as_py(), of == tile["high"][0].as_py()
        links = []
        for p, q in ((low & ~most, high), (low & most, high & ~most)):
            p, q = np.flatnonzero(p), np.flatnonzero(q)
            if len(p) and len(q):
                i, j = np.nonzero((in_common(texts, p, q) >= least_common(size[p, None], size[q], least)) & (kind[p, None] != kind[q]))
                links.append((kind[p[i]], kind[q[j]]))
        links = spanning(*(np.concatenate(x) for x in zip(*links))) if links else []
        return pa.table({"a": pa.array([min(x) for x in links], pa.int64()), "b": pa.array([max(x) for x in links], pa.int64())})

    return tiles.groupBy("key", "low", "high").applyInArrow(meet, "a long, b long")


def pairs_across(rest: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """All pairs (a < b) of texts of different classes that can have the similarity, of those in rest, (id, class): they share
    a shingle of their prefixes. At the first one that they share, what both hold of it and the smaller weight behind it
    are as much as texts of these weights have in common at the similarity."""

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(6)]
            for id_, class_, *raw in zip(*(batch.column(k).to_pylist() for k in range(5))):
                h, w, rank = (np.frombuffer(x, kind) for x, kind in zip(raw, ("<u8", "<f4", "u1")))
                shingle, left, total = prefix(h, w, rank, least)
                own = w[np.searchsorted(h, shingle.view(np.uint64))].astype(float)
                for col, x in zip(cols, (shingle, np.full(len(own), id_), np.full(len(own), class_), np.full(len(own), total), own, left - own)):
                    col.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], ["shingle", "id", "class", "total", "own", "behind"])

    told = checkpointed(vectors.join(if_few(rest), "id").select("id", "class", "h", "w", "r").mapInArrow(run, "shingle long, id long, class long, total double, own double, behind double"))
    mixed = told.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n")).where("low < high").select("shingle", "n")
    shared = checkpointed(told.join(mixed, "shingle"))
    return few_across(shared.where(F.col("n") <= FEW_TEXTS), least).unionByName(many_across(shared.where(F.col("n") > FEW_TEXTS), least)).distinct()


def few_across(shared: DataFrame, least: float) -> DataFrame:
    """The pairs across classes of shingles that few texts share, so that no text makes more than FEW_TEXTS rows."""
    groups = shared.groupBy("shingle").agg(F.array_sort(F.collect_list(F.struct("id", "class", "total", "own", "behind"))).alias("texts"))
    common = lambda a, b: F.least(a["own"], b["own"]) + F.least(a["behind"], b["behind"])
    meet = lambda a, b: (a["class"] != b["class"]) & (common(a, b) >= least_common(a["total"], b["total"], least))
    later = groups.select(F.posexplode("texts").alias("k", "a"), "texts").select("a", F.slice("texts", F.col("k") + 2, F.lit(FEW_TEXTS)).alias("later"))
    met = later.select("a", F.explode(F.filter("later", lambda b: meet(F.col("a"), b))).alias("b"))
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def many_across(shared: DataFrame, least: float) -> DataFrame:
    """The pairs across classes of shingles that many texts share: blocks of the texts meet in tiles of LIST_ROWS by
    LIST_ROWS, and only the pairs that can have the similarity leave a tile."""
    blocks = F.ceil(F.col("n") / LIST_ROWS)
    dealt = shared.withColumn("block", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    tiles = dealt.select("shingle", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "class", "total", "own", "behind")

    def meet(tile: pa.Table) -> pa.Table:
        block, *cols = (tile[c].to_numpy() for c in ("block", "id", "class", "total", "own", "behind"))
        low, high = block == block.min(), block == tile["high"][0].as_py()
        (a, class_a, total_a, own_a, behind_a), (b, class_b, total_b, own_b, behind_b) = ([c[side] for c in cols] for side in (low, high))
        common = np.minimum(own_a[:, None], own_b) + np.minimum(behind_a[:, None], behind_b)
        i, j = np.nonzero((common >= least_common(total_a[:, None], total_b, least)) & (class_a[:, None] != class_b))
        return pa.table({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j])})

    return tiles.groupBy("shingle", "low", "high").applyInArrow(meet, "a long, b long")


def least_common(a, b, least: float):
    """What two texts of these total weights have in common at the similarity, at least. The slack is for rounding."""
    return (least / (1 + least) - 1e-5) * (a + b)


def if_few(ids: DataFrame) -> DataFrame:
    """Written ids, to be broadcast if they are few, so that vectors are picked where they are."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def counted(pairs: DataFrame) -> DataFrame:
    """(id, n): in how many pairs each text is."""
    return checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n")))


def joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes, (id, class), with those that links (a, b) hold together made one. A text that no row names is a class."""
    tops = checkpointed(linked_classes(links).select(F.col("id").alias("class"), F.col("class").alias("top")))
    known = classes.unionByName(tops.select(F.col("class").alias("id"), "class")).distinct()
    return known.join(tops, "class", "left").select("id", F.coalesce("top", "class").alias("class"))


def classes_of(pairs: DataFrame, crowded: DataFrame, vectors: DataFrame, least: float, counts: bool) -> DataFrame:
    """(id, class) of the texts that links hold: those of the pairs, and those that texts of crowded buckets have across
    the classes that the pairs give."""
    classes = checkpointed(linked_classes(checkpointed(verified(pairs, vectors.join(counted(pairs), "id"), least, counts))))
    mixed = mixed_buckets(crowded, classes)
    if counts and mixed.limit(1).count():
        links = checkpointed(links_by_counts(mixed, vectors, least))
        if links.limit(1).count():
            classes = checkpointed(joined_classes(classes, links))
            mixed = mixed_buckets(crowded, classes)
    rest = checkpointed(mixed.select("id", "class").distinct())
    if not rest.limit(1).count():
        return classes
    across = checkpointed(pairs_across(rest, vectors, least))
    links = checkpointed(verified(across, vectors.join(if_few(counted(across)), "id"), least))
    if not links.limit(1).count():
        return classes
    of = lambda c: rest.select(F.col("id").alias(c), F.col("class").alias(f"class_{c}"))
    joined_ = links.select("a", "b").join(of("a"), "a").join(of("b"), "b").select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"))
    return joined_classes(classes, joined_)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, counts: bool = False) -> DataFrame:
    """One row a document: its id and class_id, the smallest id of its class; a document without near copies has its own.
    counts: texts are near copies, too, if their shingles have the similarity by counts alone.

    Texts with the same shingles as often are one text. Documents with a null text, a text without words or a null id are
    in a class of their own. Rows with equal ids are one document, and give one row each; the text that comes first by
    its signature decides. Each row counts in document frequencies. An empty table gives no rows; other columns aren't
    read, so their names may clash. Ids are integers."""
    spark = docs.sparkSession
    bound_batches(spark)
    shelf, sources = Shelf(spark), Shelf(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    usable = base.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    size = usable.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    files = min(50_000, max(32, 2 * size // FILE_BYTES))
    table = sources.put(shingle_table(usable), (files, "batch"))
    total = table.agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).first()
    dfs = sources.put(document_frequencies(table, total.shingles or 0))
    through = lambda wanted, make, schema: weighted(table, dfs, wanted, total.docs, files, make, schema)

    first = table.groupBy("id").agg(F.min(F.struct("one", "two", "batch")).alias("first")).select("id", "first.*")
    first = checkpointed(first)
    same = first.groupBy("one", "two").agg(F.min(F.struct("id", "batch")).alias("least"), F.count("*").alias("n"))
    same = checkpointed(same.select("one", "two", "n", F.col("least.id").alias("rep"), F.col("least.batch").alias("batch")))
    homes = same.select("batch", F.col("rep").alias("id"), "one")

    fields = "id long, total double, size long, keys array<long>"
    members = bucket_members(checkpointed(through(homes, band_maker, fields)))
    # whoever meets another here is all that later steps look at, so these vectors are the only ones that are kept
    meeting = homes.join(members.select("id").distinct(), "id")
    vectors = shelf.put(through(meeting, vector_maker, "id long, h binary, c binary, w binary, r binary"))
    sources.clear()
    pairs, crowded = small_pairs(members, similarity, counts), members.where(F.col("n") > CROWD).select("key", "id")
    for tier in range(1, len(TIERS)):
        crowd = members.where(F.col("n") > CROWD).select("id", "total", "size").distinct()
        if not crowd.limit(1).count():
            break
        members = bucket_members(checkpointed(vectors.join(crowd, "id").select("id", "h", "w", "total", "size").mapInArrow(band_keys_of(tier), fields)))
        pairs = pairs.unionByName(small_pairs(members, similarity, counts)).unionByName(leader_pairs(members, similarity, counts))
    pairs = checkpointed(pairs.distinct())
    classes = checkpointed(classes_of(pairs, crowded, vectors, similarity, counts)).select(F.col("id").alias("rep"), "class")
    shelf.clear()
    told = checkpointed(same.select("one", "two", "n", "rep").join(classes, "rep", "left").select("one", "two", "n", F.coalesce("class", "rep").alias("class_id")))
    told = join_by_hot_keys(first.select("id", "one", "two"), told, ["one", "two"], "n", least=1000).select("id", "class_id")
    return base.select("id").join(told, "id", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", counts: bool = False) -> DataFrame:
    """The document of each class that has the smallest id, with its own columns; documents without an id stay. Texts are
    only moved if the ids that go are too many to broadcast."""
    classes = near_duplicates(docs, id_col=id_col, counts=counts)
    gone = checkpointed(classes.where(F.col(id_col) != F.col("class_id")).select(id_col).distinct())
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti")
