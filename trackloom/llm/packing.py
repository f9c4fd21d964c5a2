"""Packing of tokenised documents into fixed windows by minimum bin slack.

Every document is tokenised in place and cut into full windows, which need no packing, and a remainder. Only the
number of remainders of each length matters to the plan, and there are fewer lengths than window positions: so the
plan is made on a table of bounded size, however many documents there are. A bitset subset-sum table says which
totals the remaining lengths can reach; the reachable total closest to the window is traced back to a multiset of
lengths, which is used as often as the counts allow. Remainders are then dealt to the places of their length by
rank, found by window functions over salted groups.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Remembered, bound_batches, checkpointed, tokenizer_path

WINDOW = 2048
END_ID = 1
#: Remainders of one length that are ranked together in one task.
GROUP_ROWS = 1_000
#: White space as the tokenizer's pattern knows it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Beyond these blocks of long-settled characters, the tokenizer itself splits the text.
UNSETTLED = re.compile(r"[^\x00-\u024f\u2010-\u2027\u20ac]")
LETTER, NUMBER = ("".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
PRE_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if visible, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder(Remembered):
    """Pre-token to its ids as little-endian 32-bit bytes, learnt from the tokenizer on demand."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, key: str) -> bytes:
        written = key.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(written)]
        return self.remember(key, pack_ids(f"<{len(ids)}I", *ids))

    def encode(self, text: str) -> bytes:
        if UNSETTLED.search(text) or any(s in text for s in self.special):
            return self.direct(text)
        return b"".join(map(self.__getitem__, PRE_TOKENS.findall(text)))


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, window: int = WINDOW, end_id: int = END_ID, encoder: type = Encoder) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens): full windows of each document, then its remainder, if any.

    A null text is empty and has the end id alone. Rows of equal id are cut each."""
    tokenizer_file = tokenizer_file or tokenizer_path("byte_bpe_50k.json")
    bound_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        known = encoder(tokenizer_file)
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                raw = (known.encode(text) if text else b"") + end
                for at in range(0, len(raw), 4 * window):
                    cut = raw[at : at + 4 * window]
                    row.append(k)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    total.append(len(raw) // 4)
            ids = batch.column(0).take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def reachable(counts: dict[int, int], window: int) -> list[tuple[int, int, int]]:
    """(length, copies, totals reachable before them as a bitset) for each step of a bounded subset-sum table.

    Copies of a length come in powers of two, so that any number of them up to the count can be formed."""
    full, bits, steps = (1 << (window + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, copies = min(counts[length], window // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, bits))
            bits |= (bits << (length * copies)) & full
            left -= copies
            copies *= 2
        if bits >> window & 1:
            break
    steps.append((0, 0, bits))
    return steps


def fullest(counts: dict[int, int], window: int) -> dict[int, int]:
    """A multiset of the remaining lengths whose total is closest to the window: length to copies.

    It holds a longest remaining length, so that hard pieces go first; the table traces back the rest."""
    longest = max(counts)
    rest = dict(counts)
    rest[longest] -= 1
    if not rest[longest]:
        del rest[longest]
    room = window - longest
    steps = reachable({k: n for k, n in rest.items() if k <= room}, room)
    total = steps[-1][2].bit_length() - 1
    used = {longest: 1}
    for length, copies, before in reversed(steps[:-1]):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + copies
            total -= length * copies
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(multiset of lengths, how many sequences it fills) until no remainder is left."""
    counts, made = dict(counts), []
    while counts:
        used = fullest(counts, window)
        times = min(counts[k] // n for k, n in used.items())
        made.append((used, times))
        for k, n in used.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return made


def places(made: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, copies a sequence, first sequence, offset there), in order of rank."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    first, rank = 0, {}
    for used, times in made:
        offset = 0
        for length in sorted(used, reverse=True):
            found.setdefault(length, []).append((rank.get(length, 0), used[length], first, offset))
            rank[length] = rank.get(length, 0) + used[length] * times
            offset += length * used[length]
        first += times
    return {k: np.array(v, np.int64) for k, v in found.items()}


def ranked(rest: DataFrame, by_length: DataFrame) -> DataFrame:
    """rest, which is written, with rank, gapless from 0 within each length. A length that many rows share is spread over
    salted groups, by the number of the row in what is written, so that equal rows are spread too."""
    groups = by_length.select("length", F.ceil(F.col("n") / GROUP_ROWS).alias("salts"))
    salted = rest.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(F.xxhash64("number"), F.col("salts"))).drop("salts")
    sizes = salted.groupBy("length", "salt").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("number")) - 1
    return salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "salt", "number")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row a piece: its document's id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    No sequence is longer than the window. A null or empty text gives one piece, the end id. Repeated rows and ids are
    packed each; equal pieces are told apart by any order, as they are alike. An empty table gives no rows. Other
    columns of docs are not read."""
    cut = checkpointed(pieces(docs, id_col=id_col, text_col=text_col, tokenizer_file=tokenizer_file, window=window, end_id=end_id))
    cut = cut.withColumn("number", F.monotonically_increasing_id())  # of a written row, so it stays the same
    whole, rest = cut.where(F.col("length") == window), cut.where(F.col("length") < window)
    by_length = rest.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_length.collect()}  # fewer rows than the window has positions
    by_length = docs.sparkSession.createDataFrame(sorted(counts.items()), "length long, n long")
    made = plan(counts, window)
    found, sequences = places(made), sum(times for _, times in made)

    def deal(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                at = found[int(x)][np.searchsorted(found[int(x)][:, 0], rank[own], "right") - 1]
                turn, place = np.divmod(rank[own] - at[:, 0], at[:, 1])
                sequence[own], offset[own] = at[:, 2] + turn, at[:, 3] + place * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    columns = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    kind = cut.schema["id"].dataType.simpleString()
    dealt = ranked(rest, by_length).select(*columns, F.col("rank").cast("long")).mapInArrow(deal, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    # a full window is a sequence by itself; its number needs no order, only to be its own
    numbered = whole.select(*columns, (F.lit(sequences) + F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.unionByName(numbered).withColumnRenamed("id", id_col)
