"""Nearest rows over cells, against all pairs."""

import numpy as np
import pytest

from trackloom.operators import graph, neighbours


def table(spark, ids, m):
    return spark.createDataFrame(list(zip(ids, m.tolist(), strict=True)), "id long, v array<double>").repartition(3)


def found(df, k, **options):
    out = {}
    for r in graph.nearest(df, "id", "v", k, **options).collect():
        out.setdefault(r.id, []).append((r["rank"], r.id2, r.weight))
    assert all([x[0] for x in sorted(near)] == list(range(1, len(near) + 1)) for near in out.values())
    return {i: [x[1:] for x in sorted(near)] for i, near in out.items()}


def all_pairs(ids, m, k):
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    m = m / norm
    scores = np.round(m @ m.T, 6)
    out = {}
    for a, i in enumerate(ids):
        order = sorted((-scores[a, b], j) for b, j in enumerate(ids) if a != b)[:k]
        out[i] = [(j, -w + 0.0) for w, j in order]
    return out


def same(got, want):
    return got.keys() == want.keys() and all([x[0] for x in got[i]] == [x[0] for x in want[i]] and np.allclose([x[1] for x in got[i]], [x[1] for x in want[i]], atol=2e-6) for i in want)


def test_by_hand(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0]), (5, [0.0, 0.0]), (6, None), (None, [1.0, 0.0]), (7, [1.0, None]), (8, [float("inf"), 1.0])], "id long, v array<double>")
    got = found(df, 2)
    assert got == {1: [(2, 1.0), (4, 0.707107)], 2: [(1, 1.0), (4, 0.707107)], 3: [(4, 0.707107), (1, 0.0)], 4: [(1, 0.707107), (2, 0.707107)]}
    assert graph.nearest(df.where("false"), "id", "v", 2).collect() == []


def test_vectors_of_two_lengths_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0])], "id long, v array<double>").coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        graph.nearest(df, "id", "v", 1).collect()


@pytest.mark.parametrize("tile", [9, neighbours.TILE])
def test_exact_over_many_cells_equals_all_pairs(spark, monkeypatch, tile):
    """A third of the rows are one vector, others come in pairs, and the rest in clusters."""
    monkeypatch.setattr(neighbours, "TILE", tile)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 5))
    m = np.concatenate([np.tile(centres[:1], (100, 1)), np.repeat(rng.standard_normal((20, 5)), 2, 0), centres[rng.integers(0, 8, 160)] + 0.1 * rng.standard_normal((160, 5))])
    ids = rng.permutation(len(m)).tolist()
    assert same(found(table(spark, ids, m), 4, exact=True, cell_rows=20), all_pairs(ids, m, 4))


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_measured_visits_find_nine_in_ten(spark, kind):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((1200, 24))
    if kind == "clustered":
        m = rng.standard_normal((30, 24))[rng.integers(0, 30, 1200)] + 0.3 * m
    want, got = all_pairs(range(1200), m, 4), found(table(spark, range(1200), m), 4, cell_rows=40)
    assert got.keys() == want.keys()
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 4 for i in want]) >= 0.9


def test_standardised(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((60, 3)) * [1, 100, 1] + [5, 0, 0]
    z = (m - m.mean(0)) / m.std(0)
    assert same(found(table(spark, range(60), m), 3, standardize=True), all_pairs(range(60), z, 3))
    edges = {(r.src, r.dst): r.weight for r in graph.knn_edges(table(spark, range(60), m), "id", "v", 3, standardize=True, exact=True).collect()}
    assert edges.keys() == {(min(i, j), max(i, j)) for i, near in all_pairs(range(60), z, 3).items() for j, _ in near}


@pytest.mark.parametrize("how", [{"exact": True}, {"recall": 0.95}])
def test_blocks_of_all_rows_meet_where_most_cells_are_visited(spark, monkeypatch, how):
    """Vectors without clusters: no row is sent to every cell it visits, and few numbers are held at once."""
    met = []
    monkeypatch.setattr(neighbours.Cells, "meet_all", lambda self, *a, f=neighbours.Cells.meet_all: met.append(1) or f(self, *a))
    monkeypatch.setattr(neighbours, "TILE", 128)
    monkeypatch.setattr(neighbours, "MATRIX", 1 << 12)
    m = np.random.default_rng(5).standard_normal((600, 32))
    m[7] = 2 * m[3]
    want, got = all_pairs(range(600), m, 4), found(table(spark, range(600), m), 4, cell_rows=10, **how)
    assert met
    if "exact" in how:
        assert same(got, want)
    else:
        assert got.keys() == want.keys()
        assert sum(len({x[0] for x in got[i]} & {x[0] for x in want[i]}) for i in want) >= 0.9 * 4 * 600


def test_a_row_alone_in_its_cell_visits_others():
    size = np.array([1, 1, 9])
    marked = neighbours.closest(1, size, 4)(np.array([[0.1, 0.2, 0.3], [0.3, 0.2, 0.1]]), None)
    assert marked.tolist() == [[True, True, True], [False, False, True]]


@pytest.mark.parametrize("k", [1, 4])
def test_blocks_that_serve_both_sides_equal_all_pairs(monkeypatch, k):
    """Single precision only tells what may count: equal weights, near copies and rows that know nobody yet come out alike."""
    rng = np.random.default_rng(6)
    m = rng.standard_normal((300, 16))
    m[100:160] = m[0] + 1e-4 * rng.standard_normal((60, 16))  # many weights of 1.000000
    unit = m / np.sqrt((m * m).sum(1, keepdims=True))
    ids = [[1, *range(900, 900 + k)] if i == 1 else [i] for i in range(300)]  # row 1 stands for several
    scores = np.round(unit @ unit.T, 6)
    want = [sorted((-scores[i, j], x) for j in range(300) if i != j for x in ids[j])[:k] for i in range(300)]
    # no limit, one that is met exactly, and one that nobody meets
    least = [-2.0 if i % 3 == 0 else -want[i][-1][0] if i % 3 == 1 else 1.1 for i in range(300)]
    rows = neighbours.pa.table({"key": [bytes([i // 256, i % 256]) for i in range(300)], "v": unit.tolist(), "ids": ids, "least": least})
    for numbers in (1 << 7, 1 << 16):
        monkeypatch.setattr(neighbours, "MATRIX", numbers)
        got = {}
        for tile in ([rows.slice(0, 150)], [rows.slice(150)], [rows.slice(0, 150), rows.slice(150)]):
            for r in neighbours.best_of_both(tile, k).to_pylist():
                got.setdefault(int.from_bytes(r["key"]), []).extend((x["less"], x["id"]) for x in r["near"])
        for i in range(300):
            near, true = sorted(got.get(i, []))[:k], want[i] if i % 3 < 2 else []
            assert [x[1] for x in near] == [x[1] for x in true] and np.allclose([x[0] for x in near], [x[0] for x in true], atol=1e-9)


def test_exact_search_of_many_cells_compares_each_pair_once(spark, monkeypatch):
    """Where most cells are visited, blocks that serve both sides find all, and what the first cells gave isn't found twice."""
    served = []
    monkeypatch.setattr(neighbours.Cells, "meet_all", lambda self, asked, choose, *a, f=neighbours.Cells.meet_all: served.append(choose is None) or f(self, asked, choose, *a))
    monkeypatch.setattr(neighbours, "TILE", 128)
    m = np.random.default_rng(8).standard_normal((500, 32))
    assert same(found(table(spark, range(500), m), 4, exact=True, cell_rows=10), all_pairs(range(500), m, 4))
    assert served == [True]


def test_blocks_grow_with_the_rows_and_hold_bounded_vectors():
    assert neighbours.block_count(102_564, 64) == 8 and neighbours.block_count(615_384, 64) == 16
    assert neighbours.block_count(100_000, 4_096) * neighbours.BLOCK_BYTES >= 100_000 * 4_096 * 8
