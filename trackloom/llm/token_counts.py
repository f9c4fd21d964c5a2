"""Token counts of whole texts by a SentencePiece model, without any shuffle.

Pieces of the model never reach across the start of a run of spaces nor across a line break, so the count of a
text is the sum over its pre-tokens. Two tiers give a pre-token's length: a broadcast table of frequent pre-tokens,
and for the rest a cache in each worker that is filled by encoding the pre-token once.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, bound_batches, tokenizer_path

#: Documents, characters of each and entries from which the table of frequent pre-tokens is drawn. They set the speed
#: of the count and never its result: whatever the table lacks is encoded.
TABLE_DOCS, TABLE_CHARS, TABLE_SIZE = 1000, 20_000, 60_000
CACHE_SIZE = 300_000
SPACES = re.compile(r" +[^ ]*|[^ ]+")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens as keys. A bare word has one space before it; a key that starts with spaces has one more than those;
    a key that starts with a line break has none, the line break itself being counted apart."""
    keys = []
    for k, line in enumerate(text.replace("▁", " ").split("\n")):
        if not k:
            line = " " + line
        if "  " in line:
            for m in SPACES.findall(line):
                keys.append(m[1:] if m[0] == " " else "\n" + m)
        elif line:
            words = line.split(" ")
            if words[0]:
                words[0] = "\n" + words[0]
                keys += words
            else:
                keys += words[1:]
    return keys


class PieceLengths(dict):
    """Pre-token to number of tokens. frequent stays; what is learnt beyond it goes when the cache is full."""

    def __init__(self, model_file: str, frequent: dict[str, int]):
        import sentencepiece

        super().__init__(frequent)
        self.frequent = frequent
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.newline = len(self.model.encode("\n")) - 1

    def __missing__(self, key: str) -> int:
        if len(self) > CACHE_SIZE + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        if key == "":
            n = len(self.model.encode("a ")) - len(self.model.encode("a"))
        elif key[0] == "\n":
            n = len(self.model.encode(key)) - len(self.model.encode("\n"))
        else:
            n = len(self.model.encode(key))
        if len(key) <= Remembered.LONGEST:
            self[key] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, pre_tokens(text))) + text.count("\n") * self.newline


def frequent_lengths(docs: DataFrame, text_col: str, model_file: str) -> dict[str, int]:
    """Lengths of the pre-tokens that a bounded sample of documents holds most often."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.substring(text_col, 1, TABLE_CHARS).alias("t")).limit(TABLE_DOCS)
    seen = Counter(key for row in texts.collect() for key in pre_tokens(row.t))
    known = PieceLengths(model_file, {})
    return {key: known[key] for key, n in seen.most_common(TABLE_SIZE) if n > 1}


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None, limit: int = 4096) -> DataFrame:
    """One row a document: its id, n_bytes (UTF-8), n_tokens, over_limit.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and repeated or null ids are counted each. Other
    columns of docs are not read, whatever their names. No begin, end or other special token is added."""
    model_file = model_file or tokenizer_path("piece_bpe_32k.model")
    spark = docs.sparkSession
    bound_batches(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, text_col, model_file))

    def run(batches):
        lengths = PieceLengths(model_file, table.value)
        for batch in batches:
            counts = [lengths.count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
