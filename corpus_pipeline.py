"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, packing, each over what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontam, minhash, packing, quality, substring_dedup
from trackloom.llm.common import checkpointed, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules and the classifier keep: null and empty texts go; repeated rows are judged each."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest id. Texts without words, null ones too, are copies
    of none; rows of equal id and rows without an id stay as the operator's own statement says."""
    return minhash.keep_one(docs, counts=True)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, rid of the passages that stand elsewhere before; n_chars is the new length where docs have it. A null
    text stays null; rows without an id lose what repeats within them; other columns stay, whatever their names."""
    own = {c: f"_own_{k}" for k, c in enumerate(docs.columns)}
    out = substring_dedup.dedup(docs.withColumnsRenamed(own), id_col=own["doc_id"], text_col=own["text"])
    if "n_chars" in docs.columns:
        out = out.withColumn(own["n_chars"], F.length(own["text"]).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(new).alias(c) for c, new in own.items()])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item. Null texts hold none; documents without an id stay."""
    return decontam.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in windows. A null text is empty, and one piece."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier, the sampling of shingles or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage packs, from all documents; of an empty table, none."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
