"""The pipeline's stages, each on what the one before kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from trackloom.llm.common import read_table

DATA = "/root/testdata/sf0.001"
TEXT = "The river ran past the mill and on to the sea, and the people of the town followed it. They came back in the evening with what they had found. Nobody asked them where it was from."
OTHER = "A long letter came from the north, and it told of the winter there. She read it twice by the fire, then put it away with the others that she had kept."


def test_stages(spark, tmp_path):
    docs = read_table(spark, DATA, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "packing":
            break
        assert docs.columns == columns
        rows = {r.doc_id: r for r in docs.collect()}
        assert rows.keys() <= before.keys() and len(rows) > 0.6 * len(before), name
        if name == "substring dedup":
            assert rows.keys() == before.keys() and all(r.n_chars == len(r.text) for r in rows.values())
        before = rows
    assert {r.doc_id for r in docs.select("doc_id").collect()} == before.keys()


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 2048


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_stages_take_odd_rows(spark):
    """Null ids and texts, repeats, empty and long texts, and columns that are named as operators' own."""
    rows = [(1, TEXT, "en", 5, True), (None, TEXT, "en", 5, None), (2, None, None, None, False), (3, "", "de", 0, True), (4, TEXT + " And more.", "en", 1, True), (4, TEXT + " And more.", "en", 1, True), (5, "word " * 9000, "en", 2, True), (6, OTHER, "fr", 3, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long, kept boolean").withColumns({"n_removed": F.lit("x"), "n_chars": F.length("text").cast("long"), "id": F.lit(7), "quality_score": F.lit(0.5)})
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.where("false")):
            out = stage(spark, table, DATA)
            got = out.collect()
            assert name == "packing" or out.columns == docs.columns
            assert len(got) == 0 if table is not docs else len(got) >= 1
            if name not in ("packing", "quality rules") and table is docs:
                assert {r.n_removed for r in got} == {"x"} and {r.id for r in got} == {7}
            if name == "substring dedup" and table is docs:
                assert len(got) == len(rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
