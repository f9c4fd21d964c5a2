"""Best-fit packing planned on a histogram of lengths.

Documents are tokenised in place; those longer than a sequence are cut into full pieces, which are sequences by
themselves, and a remainder. Best fit in falling order of length needs only how many pieces there are of each length
and how many open sequences have how much room: so it is done over these counts, which a table of bounded size holds,
however many documents there are. The plan's runs are then spread out into places by (length, rank), and pieces, ranked
within their length, take theirs by an equi-join, in which no key has more than one row on either side.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, tokenizer_path
from .packing import LETTER, NUMBER, SPACE, UNSETTLED, Encoder, pieces, ranked

WINDOW = 4096
END_ID = 1
#: Places of a run that one row of the plan spreads out into.
SPREAD = 10_000
PRE_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")


class WordEncoder(Encoder):
    """Pre-token of a lower-cased text to its ids; texts with characters beyond the settled blocks, before or after, are
    left to the library (a capital I with a dot becomes two characters, one of them a mark)."""

    def encode(self, text: str) -> bytes:
        low = text.lower()
        if not text.isascii() and (UNSETTLED.search(text) or UNSETTLED.search(low)) or any(s in text for s in self.special):
            return self.direct(text)
        return b"".join(map(self.__getitem__, PRE_TOKENS.findall(low)))


def plan(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first sequence, offset) and the number of sequences: the pieces of a run have
    ranks in a row, and each goes to the next sequence, all at the same offset.

    Longest first, each piece goes where it leaves the least room; a new sequence is begun only where none has room."""
    runs, sequences = [], 0
    open_at: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room to (first sequence, how many)
    rooms = 0  # bit r: some sequence has room r
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def put(first: int, many: int, offset: int, length: int = length) -> None:
            nonlocal left, rank
            runs.append((length, rank, many, first, offset))
            left, rank = left - many, rank + many

        while left:
            fits = rooms >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                first, many = open_at[room].pop()
                used = min(left, many)
                if used < many:
                    open_at[room].append((first + used, many - used))
                elif not open_at[room]:
                    rooms ^= 1 << room
                put(first, used, window - room)
                opened = [(first, used, room - length)]
            else:
                each, over = divmod(left, window // length)
                opened = []
                for many, copies in ((each, window // length), (1, over)):
                    if many and copies:
                        for k in range(copies):
                            put(sequences, many, k * length)
                        opened.append((sequences, many, window - copies * length))
                        sequences += many
            for first, many, room in opened:
                if room:
                    open_at[room].append((first, many))
                    rooms |= 1 << room
    return runs, sequences


def slots(docs: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """A row (length, rank, sequence_id, offset) for each place of the plan, made where it is used, never on the driver."""
    table = docs.sparkSession.createDataFrame(runs, "length long, first_rank long, many long, sequence long, offset long")
    parts = table.withColumn("from", F.explode(F.expr(f"sequence(0, many - 1, {SPREAD})")))
    parts = parts.repartition("length", "from").withColumn("k", F.explode(F.expr(f"sequence(from, least(from + {SPREAD}, many) - 1)")))
    return parts.select("length", (F.col("first_rank") + F.col("k")).alias("rank"), (F.col("sequence") + F.col("k")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row a piece: its document's id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text gives one piece, the end id. Repeated rows and ids are packed each; pieces of equal length are
    told apart by any order, as any of them fits. An empty table gives no rows. Other columns of docs are not read."""
    cut = checkpointed(pieces(docs, id_col=id_col, text_col=text_col, tokenizer_file=tokenizer_file or tokenizer_path("word_bpe_49k.json"), window=window, end_id=end_id, encoder=WordEncoder))
    cut = cut.withColumn("number", F.monotonically_increasing_id())  # of a written row, so it stays the same
    whole, rest = cut.where(F.col("length") == window), cut.where(F.col("length") < window)
    by_length = rest.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_length.collect()}  # fewer rows than a sequence has places
    by_length = docs.sparkSession.createDataFrame(sorted(counts.items()), "length long, n long")
    runs, sequences = plan(counts, window)
    columns = ["id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    placed = ranked(rest, by_length).join(slots(docs, runs), ["length", "rank"]).select(*columns)
    full = whole.withColumns({"sequence_id": F.lit(sequences) + F.col("number"), "offset": F.lit(0).cast("long")}).select(*columns)
    out = placed.unionByName(full)
    return out.select(F.col("id").alias(id_col), F.floor(F.col("start") / window).cast("int").alias("piece"), *columns[1:])
