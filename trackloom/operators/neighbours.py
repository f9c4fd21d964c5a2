"""Each row's nearest others by cosine, over an inverted file.

Equal vectors are one from the start. Their directions are dealt to the cells of k-means centres, which a bounded sample
fixes; a direction is compared with those of its own cell and of the few cells next to it. How many are visited is
either measured, on a sample of rows whose true neighbours are looked up among all, so that a stated share of neighbours
is found; or, to find all, it follows from the cells' widths: a cell whose best possible member is worse than the
neighbours that are found already is left out. The rows of a cell and those that visit it meet in tiles of bounded size,
as a product of two matrices, so no cell is too large for a task and no pairs but the best of each tile leave it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.written import passing
from .ml import scaled_vectors

#: Directions of a cell that the number of cells aims at, most cells, and directions of a cell that its centre is learnt from.
CELL_ROWS, MOST_CELLS, LEARNT_ROWS = 2_000, 1 << 15, 50
#: Most bytes of the centres, which every task holds: fewer cells are made of wider vectors.
CENTRE_BYTES = 64 << 20
#: Rows that the number of visited cells is measured on.
PROBED_ROWS = 200
#: Rows of either side of a tile.
TILE = 2_048
#: Numbers of a matrix that a task holds at once, and rows of a batch that leaves it.
MATRIX, SENT_ROWS = 1 << 21, 10_000
#: Rows of either side of a tile where blocks of all rows meet, at most, blocks that are made of fewer rows, and most bytes
#: of a block's vectors: wider ones make smaller blocks.
BLOCK, FEW_BLOCKS, BLOCK_BYTES = 40_960, 8, 64 << 20
#: What rounding may hide, in cosine; and rounding of single numbers, for each number of a vector.
SLACK, SINGLE = 2e-6, 2.0**-24


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of numbers as a matrix; a missing number is NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(flat) % max(1, len(column)):
        raise ValueError("the vectors differ in length")
    return flat.reshape(len(column), -1)


def lists(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).ravel()))


def directions(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, key, v): rows with a direction, of unit length; equal ones have equal keys."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = matrix(batch.column(1))
            norm = np.sqrt((m * m).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            unit = m[good] / norm[good, None] + 0.0  # no negative zeros
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in unit]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(keys, pa.binary()), lists(unit)], ["id", "key", "v"])

    return rows.mapInArrow(run, "id long, key binary, v array<double>")


def of_each_key(rows: DataFrame, k: int) -> DataFrame:
    """(key, v, ids): each direction once, with the k + 1 smallest of its rows' ids. A batch keeps no more of a direction
    than that before it is shuffled, so that one which most rows have makes no large group."""

    def run(batches):
        for batch in batches:
            first: dict[bytes, list[int]] = {}
            place: dict[bytes, int] = {}
            for at, (i, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                first.setdefault(key, []).append(i)
                place.setdefault(key, at)
            picked = batch.take(pa.array(list(place.values()), pa.int64()))
            yield pa.RecordBatch.from_arrays([picked.column(1), picked.column(2), pa.array([sorted(x)[: k + 1] for x in first.values()], pa.list_(pa.int64()))], ["key", "v", "ids"])

    least = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")
    parts = rows.mapInArrow(run, "key binary, v array<double>, ids array<long>")
    spread = parts.groupBy("key", (F.rand(7) * 64).cast("int").alias("salt")).agg(F.any_value("v").alias("v"), least)
    return spread.groupBy("key").agg(F.any_value("v").alias("v"), least)


def centres_of(classes: DataFrame, n: int, cells: int, seed: int) -> np.ndarray:
    """Unit centres of the cells, from a sample of some LEARNT_ROWS rows a cell of the n rows, picked by a hash."""
    share = min(1.0, cells * LEARNT_ROWS / n)
    sample = classes.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))).select(array_to_vector("v").alias("features"))
    found = KMeans(k=cells, seed=seed, maxIter=10, initMode="random").fit(sample).clusterCenters()
    m = np.array(found, float)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(norm > 0, norm, 1.0)


def angles(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ centres.T, -1.0, 1.0))


def slices(rows: int, across: int) -> Iterator[slice]:
    """Slices of so many rows whose matrix of so many columns has some MATRIX numbers."""
    step = max(1, MATRIX // max(1, across))
    return (slice(at, at + step) for at in range(0, rows, step))


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Which of a row's scores may be among its k largest, equal ones included."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    return scores >= -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]


def most_similar(own: list[bytes], v: np.ndarray, keys: list[bytes], m: np.ndarray, ids: list[list[int]], k: int) -> list[list[tuple[float, int]]]:
    """For each direction of v the k best (-weight, id) of the rows with directions m, but not those of its own key.

    Of equal weights the smaller id is better: so the k best rows are among those of the k best directions by (weight,
    smallest id)."""
    scores = np.round(v @ m.T, 6)
    place = {key: j for j, key in enumerate(keys)}
    for i, key in enumerate(own):
        if key in place:
            scores[i, place[key]] = -np.inf
    out = []
    for row, near in zip(scores, best(scores, k), strict=True):
        found = sorted((-row[j], ids[j][0], j) for j in np.flatnonzero(near) if row[j] > -np.inf)[:k]
        out.append(sorted((w, i) for w, _, j in found for i in ids[j][:k])[:k])
    return out


NEAR = pa.list_(pa.struct([("less", pa.float64()), ("id", pa.int64())]))


def as_near(found: list[list[tuple[float, int]]]) -> pa.Array:
    return pa.array([[{"less": float(w), "id": int(i)} for w, i in x] for x in found], NEAR)


def merged(parts: DataFrame, by: str, k: int) -> DataFrame:
    """The k best of all parts of each key."""
    return parts.groupBy(by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


class Cells:
    """Directions (key, v, ids) in the cells of some centres, written once."""

    def __init__(self, classes: DataFrame, centres: np.ndarray, k: int):
        self.centres, self.k = centres, k

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    v = matrix(batch.column(1))
                    home, near = np.zeros(len(v), np.int32), np.zeros(len(v))
                    for part in slices(len(v), len(centres)):
                        angle = angles(v[part], centres)
                        home[part], near[part] = angle.argmin(1), angle.min(1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(near)], ["key", "v", "ids", "home", "angle"])

        self.rows = passing(classes.select("key", "v", "ids").mapInArrow(run, "key binary, v array<double>, ids array<long>, home int, angle double"))
        self.width, self.size = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for r in self.rows.groupBy("home").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).collect():  # one row a cell
            self.width[r.home], self.size[r.home] = r.angle, r.n

    def visit(self, asked: DataFrame, choose: Callable[[np.ndarray, np.ndarray], np.ndarray], seen: DataFrame | None = None) -> DataFrame:
        """(key, near): the best of what each direction finds in the cells that choose(angles to the centres, least weight
        that counts) marks for it; asked has key, v and least. Directions are sent to the cells that they visit, unless
        that moves more than if blocks of all of them met. seen: what was found in the cells that choose leaves out, and
        counts too."""
        centres, size, k = self.centres, self.size, self.k

        def count(batches):
            visits = 0
            for batch in batches:
                if batch.num_rows:
                    v, least = matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
                    visits += sum(int((choose(angles(v[p], centres), least[p]) & (size > 0)).sum()) for p in slices(len(v), len(centres)))
            yield pa.RecordBatch.from_arrays([pa.array([visits], pa.int64())], ["visits"])

        if len(centres) > 1:
            n, blocks = int(size.sum()), block_count(int(size.sum()), centres.shape[1])
            visits = asked.select("v", "least").mapInArrow(count, "visits long").agg(F.sum("visits")).first()[0] or 0
            if visits > n * (blocks + 1):
                return self.meet_all(asked, choose if seen is None else None, blocks)

        def route(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                v, least = matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
                for part in slices(len(v), len(centres)):
                    rows, cells = np.nonzero(choose(angles(v[part], centres), least[part]) & (size > 0))
                    for at in range(0, len(rows), SENT_ROWS):
                        own = pa.array(rows[at : at + SENT_ROWS] + part.start)
                        yield pa.RecordBatch.from_arrays([c.take(own) for c in batch.columns[:2]] + [pa.array(cells[at : at + SENT_ROWS], pa.int32())], ["key", "v", "cell"])

        routed = passing(asked.select("key", "v", "least").mapInArrow(route, "key binary, v array<double>, cell int"))
        guests = {r.cell: r.n for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
        spark = asked.sparkSession
        tiles = spark.createDataFrame([(int(c), -(-int(size[c]) // TILE), -(-n // TILE)) for c, n in sorted(guests.items())], "cell int, blocks int, groups int")
        deal = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        members = self.rows.withColumnRenamed("home", "cell").join(F.broadcast(tiles), "cell").select("cell", deal("blocks", 1).alias("block"), every("groups").alias("group"), "key", "v", "ids")
        visitors = routed.join(F.broadcast(tiles), "cell").select("cell", every("blocks").alias("block"), deal("groups", 2).alias("group"), "key", "v", F.lit(None).cast("array<long>").alias("ids"))

        def meet(tile: pa.Table) -> pa.Table:
            tile = tile.combine_chunks()
            asks = pa.compute.is_null(tile["ids"])
            q, d = tile.filter(asks), tile.filter(pa.compute.invert(asks))
            if not q.num_rows or not d.num_rows:
                found = [[] for _ in range(q.num_rows)]
            else:
                one = lambda t, c: t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0)
                found = most_similar(q["key"].to_pylist(), matrix(one(q, "v")), d["key"].to_pylist(), matrix(one(d, "v")), d["ids"].to_pylist(), k)
            return pa.table({"key": q["key"], "near": as_near(found)})

        met = members.unionByName(visitors).groupBy("cell", "block", "group").applyInArrow(meet, "key binary, near array<struct<less: double, id: long>>")
        return merged(met if seen is None else met.unionByName(seen), "key", k)

    def meet_all(self, asked: DataFrame, choose: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, blocks: int) -> DataFrame:
        """What visit() gives, by tiles of two blocks of directions each: so every direction is sent once to each block,
        however many cells it visits. Both blocks of a tile ask, and see of the other what lies in the cells they visit;
        without choose, all of it, and each product of two rows then serves both."""
        centres, k = self.centres, self.k
        rows = self.rows.select("key", "v", "ids", "home").join(asked.select("key", "least"), "key")
        dealt = rows.withColumn("own", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(blocks)).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other")
        met = dealt.select("*", other).select(F.least("own", "_other").alias("low"), F.greatest("own", "_other").alias("high"), "own", "key", "v", "ids", "home", "least")

        def meet(tile: pa.Table) -> pa.Table:
            tile = tile.combine_chunks()
            low, high = tile["low"][0].as_py(), tile["high"][0].as_py()
            sides = [tile.filter(pa.compute.equal(tile["own"], b)).combine_chunks() for b in dict.fromkeys((low, high))]
            out = []
            if choose is None:
                return best_of_both(sides, k)
            for q, d in ((sides[0], sides[-1]), (sides[-1], sides[0]))[: len(sides)]:
                if q.num_rows and d.num_rows:
                    out.append(best_of_block(q, d, centres, choose, k))
            return pa.concat_tables(out) if out else pa.table({"key": pa.array([], pa.binary()), "near": pa.array([], NEAR)})

        # a tile is much work for few bytes: tasks are not made of several because they are small
        tiles = met.repartition(blocks * (blocks + 1), "low", "high")
        found = tiles.groupBy("low", "high").applyInArrow(meet, "key binary, near array<struct<less: double, id: long>>")
        return merged(found, "key", k)


def block_count(n: int, width: int) -> int:
    """Blocks that n rows of so many numbers are dealt to."""
    rows = max(1, min(BLOCK, BLOCK_BYTES // (8 * width)))
    return max(-(-n // rows), min(-(-n // TILE), FEW_BLOCKS), 1)


def of_each(at: np.ndarray, less: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """The places of the k least (less, tie) of each row, rows in order."""
    order = np.lexsort((tie, less, at))
    own = at[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


class Block:
    """Directions (key, v, ids, least) of a block, and the best that they have found in another: (row, less, other's row)."""

    def __init__(self, rows: pa.Table, k: int):
        self.k, self.keys, self.v = k, rows["key"].combine_chunks(), matrix(rows["v"].combine_chunks())
        self.single, self.least = self.v.astype(np.float32), rows["least"].to_numpy().copy()
        ids = rows["ids"].combine_chunks()
        self.ids, self.count = ids.flatten().to_numpy(), ids.value_lengths().to_numpy()
        self.start = np.cumsum(self.count) - self.count
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def limit(self, other: Block) -> None:
        """Rows that know of fewer than k others so far want the k best of the other block at most."""
        rows = np.flatnonzero(self.least < -1)
        if len(other.v) <= self.k:
            return
        for part in slices(len(rows), len(other.v)):
            scores = self.v[rows[part]] @ other.v.T
            if other is self:
                scores[np.arange(len(scores)), rows[part]] = -np.inf
            self.least[rows[part]] = np.maximum(self.least[rows[part]], -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1] - SLACK)

    def offer(self, own: np.ndarray, theirs: np.ndarray, weight: np.ndarray, other: Block) -> None:
        good = weight >= self.least[own] - SLACK
        self.parts.append((own[good], -np.round(weight[good], 6), theirs[good]))
        self.size += len(self.parts[-1][0])
        if self.size > MATRIX + 4 * self.k * len(self.v):
            self.reduce(other)

    def reduce(self, other: Block) -> None:
        own, less, theirs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        best_ = of_each(own, less, other.ids[other.start[theirs]], self.k)
        self.parts, self.size = [(own[best_], less[best_], theirs[best_])], len(best_)

    def found(self, other: Block) -> pa.Table:
        """(key, near), with the ids of the other's rows."""
        self.reduce(other)
        own, less, theirs = self.parts[0]
        many = np.minimum(other.count[theirs], self.k)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        own, less, ids = np.repeat(own, many), np.repeat(less, many), other.ids[np.repeat(other.start[theirs], many) + nth]
        best_ = of_each(own, less, ids, self.k)
        own, first = np.unique(own[best_], return_index=True)
        near = pa.StructArray.from_arrays([pa.array(less[best_]), pa.array(ids[best_], pa.int64())], ["less", "id"])
        lists_ = pa.ListArray.from_arrays(pa.array(np.append(first, len(best_)), pa.int32()), near)
        return pa.table({"key": self.keys.take(pa.array(own)), "near": lists_})


def weights(a: np.ndarray, b: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The products of some pairs of rows: of all, where they are many, or as many at once as make a matrix of bounded size."""
    if 8 * len(at) > len(a) * len(b):
        return (a @ b.T)[at, to]
    step = max(1, MATRIX // a.shape[1])
    return np.concatenate([np.einsum("ij,ij->i", a[at[i : i + step]], b[to[i : i + step]]) for i in range(0, len(at), step)])


def best_of_both(sides: list[pa.Table], k: int) -> pa.Table:
    """(key, near): for each row of either side the k best rows of the other (of its own, if there is one side) that are no
    worse than its least weight. Single precision tells which pairs can be, double precision what they weigh."""
    if not all(x.num_rows for x in sides):
        return pa.table({"key": pa.array([], pa.binary()), "near": pa.array([], NEAR)})
    blocks = [Block(x, k) for x in sides]
    a, b = blocks[0], blocks[-1]
    for one, other in dict.fromkeys(((a, b), (b, a))):
        one.limit(other)
    hidden = SLACK + (a.v.shape[1] + 8) * SINGLE
    low, high = ((x.least - hidden).astype(np.float32) for x in (a, b))
    side = max(1, int((MATRIX / 2) ** 0.5))
    for i in range(0, len(a.v), side):
        for j in range(0, len(b.v), 2 * side):
            p, q = slice(i, i + side), slice(j, j + 2 * side)
            scores = a.single[p] @ b.single[q].T
            near = scores >= low[p, None]
            if a is not b:
                near |= scores >= high[None, q]
            at, to = np.divmod(np.flatnonzero(near), near.shape[1])
            if a is b:
                other = at + i != to + j
                at, to = at[other], to[other]
            if len(at):
                weight = weights(a.v[p], b.v[q], at, to)
                a.offer(at + i, to + j, weight, b)
                if a is not b:
                    b.offer(to + j, at + i, weight, a)
    return pa.concat_tables([one.found(other) for one, other in dict.fromkeys(((a, b), (b, a))) if one.parts] or [pa.table({"key": pa.array([], pa.binary()), "near": pa.array([], NEAR)})])


def best_of_block(q: pa.Table, d: pa.Table, centres: np.ndarray, choose: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int) -> pa.Table:
    """(key, near): for each direction of q the k best rows of d in the cells that are marked for it and no worse than its
    least weight; a slice of q at a time."""
    v, m, homes = matrix(q["v"].combine_chunks()), matrix(d["v"].combine_chunks()), d["home"].to_numpy()
    keys, least, known = q["key"].to_pylist(), q["least"].to_numpy(), d["key"].to_pylist()
    ids = d["ids"].to_pylist()
    first = np.array([x[0] for x in ids])
    place = {key: j for j, key in enumerate(known)}
    own = np.array([place.get(key, -1) for key in keys])
    told, found = [], []
    for part in slices(len(v), max(len(m), len(centres))):
        scores = v[part] @ m.T
        marked = choose(angles(v[part], centres), least[part])
        if not marked.all():
            scores[~marked[:, homes]] = -np.inf
        mine = np.flatnonzero(own[part] >= 0)
        scores[mine, own[part][mine]] = -np.inf
        near = scores >= least[part, None] - SLACK
        if near.sum() > 4 * k * len(near):
            near &= scores >= -np.partition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, min(k, scores.shape[1]) - 1, None] - SLACK
        near &= scores > -np.inf
        at, j = np.nonzero(near)
        less = -np.round(scores[at, j], 6)
        order = np.lexsort((first[j], less, at))
        at, j, less = at[order], j[order], less[order]
        start = np.searchsorted(at, at)
        keep = np.arange(len(at)) - start < k
        best_: dict[int, list[tuple[float, int]]] = {}
        for row, w, x in zip(at[keep].tolist(), less[keep].tolist(), j[keep].tolist(), strict=True):
            best_.setdefault(row, []).extend((w, i) for i in ids[x][:k])
        told += [keys[part.start + row] for row in best_]
        found += [sorted(x)[:k] for x in best_.values()]
    return pa.table({"key": pa.array(told, pa.binary()), "near": as_near(found)})


def true_ranks(cells: Cells, seed: int) -> np.ndarray:
    """For a sample of rows and each of their true neighbours, how many cells lie closer to the row than the neighbour's:
    all rows are compared with the sample, which is small."""
    picked = cells.rows.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(PROBED_ROWS).select("key", "v").collect()
    keys, v, k = [bytes(r.key) for r in picked], np.array([r.v for r in picked]), cells.k

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            known, homes = batch.column(0).to_pylist(), batch.column(3).to_numpy()
            found = most_similar(keys, v, known, matrix(batch.column(1)), [[j] for j in range(len(known))], k)
            near = [[{"less": float(w), "id": int(homes[j])} for w, j in x] for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(keys)), pa.int32()), pa.array(near, NEAR)], ["row", "near"])

    parts = cells.rows.mapInArrow(run, "row int, near array<struct<less: double, id: long>>")
    order = angles(v, cells.centres).argsort(1, kind="stable").argsort(1)
    return np.array(sorted(order[r.row, x.id] for r in merged(parts, "row", k).collect() for x in r.near))  # PROBED_ROWS rows


def closest(n: int, size: np.ndarray, k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The n cells closest to each row, and further ones where those hold fewer than k others."""
    def choose(angle: np.ndarray, least: np.ndarray) -> np.ndarray:
        marked = best(-angle, n)
        for row in np.flatnonzero(marked @ size <= k):
            order = angle[row].argsort(kind="stable")
            marked[row, order[: np.searchsorted(size[order].cumsum(), k + 1) + 1]] = True
        return marked

    return choose


def unseen(n: int, width: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The cells beyond the n closest that may hold what is no worse than `least`."""
    return lambda angle, least: ~best(-angle, n) & (np.cos(np.maximum(angle - width, 0)) + SLACK >= least[:, None])


def nearest(vectors: DataFrame, id_col: str, vector_col: str, k: int = 4, *, exact: bool = False, recall: float = 0.95, cell_rows: int = CELL_ROWS, standardize: bool = False, seed: int = 3) -> DataFrame:
    """(id, id2, weight, rank): each row's k most similar others by cosine, to six decimals, the smaller id of equals.

    exact finds them all; else so many cells are visited that a sample of rows finds `recall` of its neighbours in them.
    Up to cell_rows different directions are one cell, and found all either way. standardize: by the numbers' deviations
    from their means over all rows, in units of their standard deviations. Ids are integers; rows without an id, a vector
    or a direction (a zero, missing or infinite number's) take no part."""
    if standardize:
        scaled = scaled_vectors(vectors.where(F.col(vector_col).isNotNull()), vector_col)
        vectors, vector_col = scaled.select(F.col(id_col).alias("id"), vector_to_array("features").alias("v")), "v"
        id_col = "id"
    rows = passing(directions(vectors, id_col, vector_col))
    classes = passing(of_each_key(rows, k))
    told = classes.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("width")).first()
    count = max(1, min(told.n // cell_rows, MOST_CELLS, CENTRE_BYTES // (8 * told.width)))
    # any direction is the centre of a single cell
    cells = Cells(classes, centres_of(classes, told.n, count, seed) if count > 1 else np.eye(1, told.width), k)
    asked = cells.rows.select("key", "v", F.lit(-2.0).alias("least"))
    if exact or len(cells.centres) == 1:
        first = min(2, len(cells.centres))
        found = cells.visit(asked, lambda angle, least: best(-angle, first))
        if first < len(cells.centres):
            found = passing(found)
            least = F.when(F.size("near") >= k, -F.element_at("near", -1)["less"]).otherwise(-2.0)
            asked = cells.rows.join(found, "key", "left").select("key", "v", F.coalesce(least, F.lit(-2.0)).alias("least"))
            found = cells.visit(asked, unseen(first, cells.width), found)
    else:
        ranks = true_ranks(cells, seed)
        visits = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else 1
        found = cells.visit(asked, closest(visits, cells.size, k))
    # the other rows of the same direction; their weight is 1
    others = F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("less"), i.alias("id")))
    every = cells.rows.join(found, "key", "left").select("key", F.array_sort(F.concat(F.coalesce("near", F.array().cast("array<struct<less: double, id: long>>")), others)).alias("near"))
    pairs = rows.select("id", "key").join(every, "key").select("id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)).alias("rank", "x"))
    return pairs.select("id", F.col("x.id").alias("id2"), (-F.col("x.less")).alias("weight"), (F.col("rank") + 1).alias("rank"))
