"""Spelling variants: words that differ by one code point from one that is far more frequent.

Two words at one inserted, deleted or replaced code point share a half: what stands before the middle of the shorter one
or what stands after it. So words are dealt to blocks by either half, and a task holds those of its blocks in two minimal
acyclic automata, one that reads words forward and one that reads them backward. A word's shared half is matched exactly
there and the other half completed with one error; paths number the words they spell, so that a match leads to its
frequency. A block with too many words is dealt anew by the halves of what its words need not share, so a half that
millions of words have in common makes no large task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is so many times as frequent at least.
TIMES = 5
#: Every run whose hash this divides loses a code point.
DIVISOR = 199
RUNS = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
#: Words that a task counts before it hands their counts on.
HELD = 200_000
#: Most words of a block, and of the automata that a task builds at once (besides the last block).
BLOCK_WORDS = 20_000


def counts_of(name: str, text: str) -> Iterator[tuple[str, int]]:
    """The runs of a text that can be words, as they count: a run whose hash the divisor divides without a code point."""
    for run, n in Counter(RUNS.findall(text)).items():
        h = zlib.crc32(f"{name}:{run}".encode())
        if h % DIVISOR == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, n


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """Rows (word, n) of all words that occur often enough in all texts; each task adds up its own counts first."""
    bound_batches(docs.sparkSession)

    def run(batches):
        held: dict[str, int] = {}

        def handed():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()

        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.large_binary())
            for name, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                # bytes know capitals of A to Z alone
                for word, n in counts_of(name, text.as_py().lower().decode()):
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield from handed()
        yield from handed()

    named = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Automaton:
    """The minimal acyclic automaton of sorted, distinct strings. A state is [ends a string, how many strings it leads to,
    letter to (next state, how many strings come before)]: the sum along a path is the number of the string it spells."""

    def __init__(self, strings: list[str]):
        self.known: dict[tuple, list] = {}
        self.start, path, last = [False, 0, {}], [], ""
        for s in strings:
            k = 0
            while k < len(last) and k < len(s) and last[k] == s[k]:
                k += 1
            self.settle(path, k)
            state = path[-1][2] if path else self.start
            for letter in s[k:]:
                new = [False, 0, {}]
                path.append((state, letter, new))
                state[2][letter] = (new, 0)
                state = new
            state[0], last = True, s
        self.settle(path, 0)
        self.number(self.start)
        del self.known

    def number(self, state: list) -> None:
        """Count the strings of a state whose next states are settled."""
        n = int(state[0])
        for letter, (child, _) in state[2].items():
            state[2][letter] = (child, n)
            n += child[1]
        state[1] = n

    def settle(self, path: list[tuple], keep: int) -> None:
        """Nothing more will be added below the first `keep` letters: states that lead to the same endings become one."""
        while len(path) > keep:
            parent, letter, child = path.pop()
            self.number(child)
            mark = (child[0], *((x, id(y)) for x, (y, _) in child[2].items()))
            parent[2][letter] = (self.known.setdefault(mark, child), 0)

    @staticmethod
    def follow(state: list, number: int, letters: str) -> tuple[list | None, int]:
        for letter in letters:
            found = state[2].get(letter)
            if not found:
                return None, 0
            state, number = found[0], number + found[1]
        return state, number

    def at(self, state: list, number: int, letters: str) -> Iterator[int]:
        state, number = self.follow(state, number, letters)
        if state and state[0]:
            yield number

    def one_replaced(self, shared: str, rest: str) -> Iterator[int]:
        """Numbers of the strings that are shared + rest with one letter of rest replaced."""
        state, number = self.follow(self.start, 0, shared)
        for k, own in enumerate(rest):
            for letter, (child, before) in state[2].items():
                if letter != own:
                    yield from self.at(child, number + before, rest[k + 1 :])
            state, number = self.follow(state, number, own)

    def one_deleted(self, shared: str, rest: str) -> Iterator[int]:
        """Numbers of the strings that are shared + rest without one letter of rest."""
        state, number = self.follow(self.start, 0, shared)
        for k, own in enumerate(rest):
            if not k or own != rest[k - 1]:  # either of two equal neighbours leaves the same string
                yield from self.at(state, number, rest[k + 1 :])
            state, number = self.follow(state, number, own)


def near_words(rows: list[tuple[str, str, int, int, int, int, int]]) -> list[tuple[str, int, int, str]]:
    """(word, near words found here, n and spelling of the most frequent one) from rows (block, word, n, m, a, b, high) of
    whole blocks: words of m or m + 1 letters that share the first a and the last b."""
    out: dict[str, tuple[int, int, str]] = {}

    def note(word: str, near: str, n: int) -> None:
        count, most, spelling = out.get(word, (0, 0, ""))
        out[word] = (count + 1, n, near) if not count or (-n, near) < (-most, spelling) else (count + 1, most, spelling)

    for backward in (False, True):
        spelt = []
        for block, word, n, m, a, b, high in rows:
            if backward == (high > 0):
                rest = word[a : len(word) - b]
                spelt.append((f"{block} ", rest[::-1] if backward else rest, word, n, m, high))
        spelt.sort(key=lambda x: x[0] + x[1])
        words = Automaton([x[0] + x[1] for x in spelt])
        for shared, rest, word, n, m, high in spelt:
            longer = len(word) > m
            for k in words.one_deleted(shared, rest) if longer else words.one_replaced(shared, rest):
                near, its = spelt[k][2], spelt[k][3]
                if high and word[:high] == near[:high]:
                    continue  # they meet in a block of the first half
                note(word, near, its)
                if longer:
                    note(near, word, n)
    return [(word, *x) for word, x in out.items()]


def halves(rows: DataFrame) -> DataFrame:
    """Each row in the two blocks of its block: of words that also share the first half of what the block leaves open, and
    of those that also share the last. high: words of a block that share so many first letters meet in another block."""
    half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    first = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"), F.col("high").alias("high"))
    last = F.struct(F.col("a").alias("a"), (F.col("m") - F.col("a") - half).alias("b"), (F.col("a") + half).alias("high"))
    dealt = rows.select("word", "n", "m", F.explode(F.array(first, last)).alias("x")).select("word", "n", "m", "x.*")
    ends = F.concat(F.expr("substring(word, 1, a)"), F.lit(" "), F.expr("substring(word, length(word) - b + 1, b)"))
    return dealt.withColumn("block", F.concat_ws(" ", "m", "a", "b", "high", ends))


def blocks(words: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """Rows (word, n, m, a, b, high, block): all words by the halves they may share with a near one. Blocks of more than
    `most` words are dealt anew, until one letter at most is open: the alphabet bounds such a block."""
    lengths = F.array(F.length("word"), F.length("word") - 1)
    start = words.select("word", "n", F.explode(lengths).alias("m")).where(F.col("m") >= LEAST_LENGTH)
    rows = halves(start.withColumns({c: F.lit(0) for c in ("a", "b", "high")}))
    while True:
        sizes = rows.where(F.col("m") - F.col("a") - F.col("b") > 1).groupBy("block").count()
        full = checkpointed(sizes.where(F.col("count") > most).select("block"))
        if not full.limit(1).count():
            return rows
        heads = F.broadcast(full)  # a small fixed share of the blocks' rows: one for `most` of them at the most
        rows = checkpointed(rows.join(heads, "block", "left_anti").unionByName(halves(rows.join(heads, "block", "left_semi"))))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the path word, form, form of the form. Paths are halved in each round."""
    steps = checkpointed(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        taken = checkpointed(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = taken.drop("moved")
        if not taken.where("moved").limit(1).count():
            return steps


def group_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (word, n, n_near, form, form_n, root), one for each word of at least 6 code points that occurs 5 times or more.

    A null text has no words; a null id is written as nothing where runs are hashed. Texts of repeated rows count each.
    Of equally frequent near words, the smallest in code-point order is the form. An empty table gives no rows. Other
    columns of docs are not read."""
    words = checkpointed(count_words(docs, id_col=id_col, text_col=text_col))

    def run(batches):
        held, last = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and len(held) >= block_words:
                    yield found(held)
                    held = []
                held.append(row)
                last = row[0]
        yield found(held)

    def found(rows):
        near = near_words(rows)
        columns = list(zip(*near, strict=True)) if near else [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n_near", "form_n", "form"])

    dealt = blocks(words, block_words).select("block", "word", "n", "m", "a", "b", "high")
    pairs = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(run, "word string, n_near long, form_n long, form string")
    alone = words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("form"), "n")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form")))).alias("best")
    table = alone.unionByName(pairs.withColumn("n", F.lit(None).cast("long"))).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    kept = -F.col("best.less") >= TIMES * F.col("n")
    table = checkpointed(table.select("word", "n", "n_near", F.when(kept, F.col("best.form")).alias("form"), F.when(kept, -F.col("best.less")).alias("form_n")))
    return table.join(roots(table), "word", "left").withColumn("root", F.coalesce("root", "word"))
