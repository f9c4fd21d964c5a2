"""Filter audit, spelling variants and best-fit packing against plain versions of them."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.llm import best_fit, filter_audit, queries, spelling
from trackloom.llm.common import tokenizer_path

DATA = "/root/testdata/sf0.001"
LETTERS = list("ab AB\n\t\x1c#é漢 c&*") + ["word ", "the ", "the "]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(LETTERS, k=rng.choice([0, 1, 3, 30, 900]))) for _ in range(n)]


def plain_mask(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t))]
    return sum(f << k for k, f in enumerate(fails))


@pytest.mark.parametrize("block", [7, filter_audit.BLOCK])
def test_scanner_equals_plain_rules(monkeypatch, block):
    monkeypatch.setattr(filter_audit, "BLOCK", block)
    texts = [*random_texts(600, 1), None, "a", "b", " ", "", "x" * 99, None]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(texts).slice(5, 300), pa.array([], pa.string()), pa.array([None], pa.string())):
        mask, digests = filter_audit.failures(column)
        assert list(mask) == [plain_mask(t) for t in column.to_pylist()]
        assert len(digests) == len(column)


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    texts = random_texts(300, 2)
    monkeypatch.setattr(filter_audit, "word_hashes", lambda raw, start, end: (end - start).astype(np.uint64) % np.uint64(2))
    assert list(filter_audit.failures(pa.array(texts))[0]) == [plain_mask(t) for t in texts]


def plain_audit(docs, labels):
    first, out = {}, {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    rows = [(part or "", plain_mask(t) + 16 * (d is not None and d > first[t or ""]), d in good, d in toxic) for d, t, part in docs]
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            before = 0
            for k, f in enumerate(order):
                bit = 1 << "ABCDE".index(f)
                gone = [r for r in own if r[1] & bit and not r[1] & before]
                removed_by[f] += len(gone)
                kept = sum(not r[1] & (before | bit) for r in own)
                late = sum(1 for r in own if r[1] & bit and r[1] & before)
                out[part, "".join(order), k + 1] = [kept, len(gone), late, sum(r[1] == bit for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
                before |= bit
        for key, x in out.items():
            if key[0] == part:
                x[-1] = removed_by[x[-1]]
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [*random_texts(40, 4), None, "", "same words " * 150]
    docs = [(rng.choice([None, *range(60)]), rng.choice([*texts, texts[-1], texts[-1]]), rng.choice(["en", "de", None, ""])) for _ in range(400)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"mask": F.lit(1), "n": F.lit("x"), "part": F.lit(None).cast("string"), "digest": F.lit(2)})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(table.repartition(5), known).collect()}
    assert got == plain_audit(docs, labels)


def test_audit_of_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(odd, labels).collect()
    assert {r.part for r in rows} == {"", "en", "de", "fr"} and len(rows) == 4 * 600
    assert filter_audit.audit(none, labels).collect() == []


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(docs):
    counts = Counter()
    for d, t in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, out = {}, {}
    for w in words:
        near = [v for v in words if one_apart(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
        out[w] = [words[w], len(near), form[w], words.get(form[w])]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return out


@pytest.mark.parametrize("most", [4, spelling.BLOCK_WORDS])
def test_variants_equal_brute_force(spark, most):
    rng = random.Random(5)
    words = ["".join(rng.choices("abÀ", k=rng.randint(6, 9))) for _ in range(60)] + ["aaaaaaaa" + "a" * k for k in range(5)] + ["ababababab", "abababababa", "prefixxone", "prefixxtwo"]
    weights = [rng.choice([1, 1, 6, 40]) for _ in words]
    docs = [(rng.choice([None, *range(500)]), rng.choice([" ", ", ", "1"]).join(rng.choices(words, weights, k=60)).replace("a", rng.choice("aA"))) for _ in range(80)]
    docs += [(None, None), (1, ""), (2, "ÀB" * 30)] * 6 + [(9, "rootword " * 200 + "rootwora " * 30 + "rootwra " * 6)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x")})
    got = {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in spelling.group_variants(table.repartition(4), block_words=most).collect()}
    want = plain_variants(docs)
    assert got == want and any(x[2] and x[4] != x[2] for x in want.values())


def test_variants_of_odd_tables(odd, none):
    assert spelling.group_variants(odd).collect() == []
    assert spelling.group_variants(none).collect() == []


def test_full_blocks_are_dealt_anew(spark):
    words = spark.createDataFrame([(f"shared{a}{b}{c}{d}", 5) for a in "abcd" for b in "abcd" for c in "abcd" for d in "abcd"], "word string, n long")
    assert spelling.blocks(words, 20).where("m - a - b > 1").groupBy("block").count().where("count > 20").count() == 0


def test_automaton_is_minimal_and_numbers_its_strings():
    strings = sorted({"".join(random.Random(k).choices("ab", k=k % 7 + 1)) for k in range(200)})
    found = spelling.Automaton(strings)
    for k, s in enumerate(strings):
        assert list(found.at(found.start, 0, s)) == [k]
    assert not list(found.at(found.start, 0, "abc"))
    states, todo = {}, [found.start]
    while todo:
        state = todo.pop()
        if id(state) not in states:
            states[id(state)] = state
            todo += [x for x, _ in state[2].values()]

    def endings(state):
        return frozenset([""] * state[0]) | {c + e for c, (x, _) in state[2].items() for e in endings(x)}

    assert len({endings(s) for s in states.values()}) == len(states)


def plain_best_fit(lengths, window):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is None:
            rooms.append(window - x)
        else:
            rooms[rooms.index(fit)] -= x
    return Counter(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_of_single_pieces(seed):
    rng = random.Random(seed)
    window = rng.choice([7, 50, 400])
    counts = Counter(rng.choice([rng.randint(1, window - 1), rng.randint(1, max(1, window // 5))]) for _ in range(rng.choice([1, 30, 900])))
    runs, sequences = best_fit.plan(dict(counts), window)
    inside, ranks = defaultdict(list), defaultdict(list)
    for length, first, many, sequence, offset in runs:
        for k in range(many):
            ranks[length].append(first + k)
            inside[sequence + k].append((offset, length))
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in counts.items()}
    rooms = Counter()
    for places in inside.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        rooms[window - at] += 1
    assert sum(rooms.values()) == sequences and rooms == plain_best_fit(counts.elements(), window)


def test_word_ids_equal_the_library():
    encoder = best_fit.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    pool = list("abc the éñßİÀÆ'sDLVEM t.,!?|*0159²½\n\n  \t\r\x0b\x1c\x85\xa0▁　漢ªǅ€—“]^-\\") + ["ing", " The", "  ", "'S", "'re", "<|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "\r\n"]
    rng = random.Random(6)
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 25))) for _ in range(4000)] + [chr(c) + "a" + chr(c) for c in range(0x250)]
    for t in texts:
        assert encoder.encode(t) == encoder.direct(t), repr(t)


@pytest.mark.parametrize("window", [16, 4096])
def test_best_fit_is_an_exact_round_trip(odd, none, window):
    encoder = best_fit.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    rows = best_fit.pack(odd, window=window).collect()
    ids = {r.doc_id: np.append(np.frombuffer(encoder.direct(r.text or ""), "<u4"), 1).astype("<u4") for r in odd.collect()}
    times = Counter(r.doc_id for r in odd.collect())
    seen, sequences = Counter(), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == r.piece * window and r.length == min(window, len(ids[r.doc_id]) - r.start) and zlib.crc32(own.tobytes()) == r.ids_crc32
        seen[r.doc_id, r.piece] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert seen == {(d, k): times[d] for d in ids for k in range(-(-len(ids[d]) // window))}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    assert best_fit.pack(none).collect() == []


def test_places_of_long_runs_are_spread(spark, odd, monkeypatch):
    monkeypatch.setattr(best_fit, "SPREAD", 3)
    got = sorted(map(tuple, best_fit.slots(odd, [(5, 2, 10, 7, 1), (4, 0, 1, 0, 0)]).collect()))
    assert got == sorted([(5, 2 + k, 7 + k, 1) for k in range(10)] + [(4, 0, 0, 0)])


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_spelling_variants"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = queries.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rel = con.sql(queries.oracle_sql()[name])
    want = [tuple(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall()]
    assert sorted(rel.columns) == columns
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want))
