"""Ingestion cuts each text once."""

from loomwork.streaming import jobs


def test_a_text_is_cleaned_and_cut_once(spark):
    docs = spark.createDataFrame([(1, "a. b", "en"), (2, "", "en"), (3, None, "de")], "doc_id long, text string, lang string")
    cuts = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")
    found = jobs.ingest(docs)
    assert cuts(found) == 1
    assert sorted((r.doc_id, r.chunk_index, r.content) for r in found.collect()) == [(1, 0, "a. b"), (2, 0, ""), (3, 0, "")]
