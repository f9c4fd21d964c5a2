"""Removal of passages that repeat within or across documents, by sliding spans of sentences.

A text is cut into sentences; a sentence longer than a line of speech is cut further after words picked by their hash,
so that a passage is cut alike wherever it stands. From every sentence the shortest run of several sentences with
enough words is hashed. Equal runs are found by a global join; all but the first place of a run are covered, and
covered sentences are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bound_batches, checkpointed, join_by_hot_keys, powers

#: A run has at least so many sentences and words.
RUN_SENTENCES, RUN_WORDS = 2, 16
#: A sentence longer than this is cut after every word whose hash says so, one in CUT.
LONG_SENTENCE, CUT = 24, 6
#: Characters that end a sentence where white space follows.
STOPS = ".!?…。！？"
STOP, SPACE = 1 << 21, 1 << 42
FACTORS = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)


class Cutter:
    """Sentences and runs of a text."""

    def __init__(self):
        self.words, self.size = Words(), 0
        # line breaks, stops and white space are counted in one number, each kind in digits of its own
        self.kind = np.array([(c == 10) + (c < 1 << 16 and chr(c) in STOPS) * STOP + chr(c).isspace() * SPACE for c in range(Words.PLAIN + 1)], np.int64)

    def ready(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size, 4096)
            self.up = [powers(f, self.size) for f in FACTORS]
            self.down = [powers(pow(f, -1, 1 << 64), self.size) for f in FACTORS]

    def sentences(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and place of each word, and the number of the first word of each sentence with the number of words at the
        end. A sentence ends before a word if a line break, or a stop and white space, stand between it and the last one."""
        codes = self.words.codes(text)
        h, start, end = self.words.of(text, codes)
        if not len(h):
            return h, start, np.zeros(1, np.int64)
        sums = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(self.kind[codes], out=sums[1:])
        between = sums[start[1:]] - sums[end[:-1]]
        ends = np.ones(len(h), bool)
        ends[:-1] = (between % STOP > 0) | (between >= SPACE) & (between % SPACE >= STOP)
        size = np.diff(np.concatenate([[-1], np.flatnonzero(ends)]))
        ends |= np.repeat(size > LONG_SENTENCE, size) & (h % np.uint64(CUT) == 0)
        return h, start, np.concatenate([[0], np.flatnonzero(ends) + 1])

    def runs(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes, first sentence and number of sentences of each run, and whether it stands in the text before."""
        n = len(first) - 1
        k = np.arange(n)
        reach = np.maximum(np.searchsorted(first, first[:-1] + RUN_WORDS), k + RUN_SENTENCES)
        k = k[reach <= n]
        reach = reach[: len(k)]
        self.ready(len(h) + 1)
        out = []
        for up, down in zip(self.up, self.down):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
            out.append(((sums[first[reach]] - sums[first[k]]) * down[first[k]]).view(np.int64))
        again = np.ones(len(k), bool)
        again[np.unique(out[0] ^ (out[1] << 1), return_index=True)[1]] = False
        return out[0], out[1], k, reach - k, again

    def without(self, text: str, start: np.ndarray, first: np.ndarray, covered: np.ndarray) -> str:
        """The text without the covered sentences; what stands behind a sentence goes with it."""
        starts = np.append(start, len(text))
        parts = [text[: starts[0]]]
        for k in np.flatnonzero(~covered[: len(first) - 1]):
            parts.append(text[starts[first[k]] : starts[first[k + 1]]])
        return "".join(parts).rstrip()


def spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(one, two, id, k, n): the hashes of each run at its first place in each document, that sentence and their number."""

    def run(batches):
        cutter = Cutter()
        for batch in batches:
            ids, cols = [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                h, _, first = cutter.sentences(text)
                one, two, k, n, again = cutter.runs(h, first)
                cols.append((one[~again], two[~again], k[~again], n[~again]))
                ids.append(np.full(len(cols[-1][0]), at))
            if cols:
                one, two, k, n = (np.concatenate(x) for x in zip(*cols))
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), batch.column(0).take(pa.array(np.concatenate(ids))), pa.array(k.astype(np.int32)), pa.array(n.astype(np.int32))], ["one", "two", "id", "k", "n"])

    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"one long, two long, id {rows.schema['id'].dataType.simpleString()}, k int, n int")


def covered_sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, spans): for each document with runs that stand in an earlier document, where those are."""
    found = spans(docs, id_col, text_col)
    first = found.groupBy("one", "two").agg(F.min("id").alias("first"), F.count("*").alias("times")).where("times > 1")
    first = checkpointed(first)
    again = join_by_hot_keys(found, first, ["one", "two"], "times")
    return checkpointed(again.where("id <> first").groupBy("id").agg(F.collect_list(F.struct("k", "n")).alias("spans")))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text rid of repeated passages, n_sentences, n_removed.

    The first place of a passage, by id and position, stays; a passage that repeats within one document counts too. A
    null text stays null, with 0 sentences; a text may become empty. Rows without an id only lose what repeats within
    them. Rows of equal id are one document: none of them is earlier than the other. Columns of docs with those names give way."""
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    cover = covered_sentences(docs, id_col, text_col).select(F.col("id").alias(id_col), F.col("spans").alias("_spans"))
    known = F.col(id_col).isNotNull()  # rows without an id would all meet in one task of a shuffle
    rows = docs.where(known).select(*kept).join(cover, id_col, "left").unionByName(docs.where(~known).select(*kept, F.lit(None).cast(cover.schema["_spans"].dataType).alias("_spans")))
    rows = rows.select(*kept, F.col("_spans.k").alias("_k"), F.col("_spans.n").alias("_n"))
    at = kept.index(text_col)
    fields = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "n_sentences long, n_removed long"])

    def run(batches):
        cutter = Cutter()
        for batch in batches:
            texts, sentences, removed = batch.column(at).to_pylist(), [], []
            for i, (starts, sizes) in enumerate(zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist())):
                h, start, first = cutter.sentences(texts[i] or "")
                n = len(first) - 1
                covered = np.zeros(n, bool)
                if n:
                    _, _, own, reach, again = cutter.runs(h, first)
                    for k, size in zip([*(starts or ()), *own[again].tolist()], [*(sizes or ()), *reach[again].tolist()]):
                        covered[k : k + size] = True
                    if covered.any():
                        texts[i] = cutter.without(texts[i], start, first, covered)
                sentences.append(n)
                removed.append(int(covered.sum()))
            columns = list(batch.columns[: len(kept)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sentences, pa.int64()), pa.array(removed, pa.int64())], [*kept, "n_sentences", "n_removed"])

    return rows.mapInArrow(run, fields)
