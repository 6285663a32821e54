import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from loomwork.llm import packing, pii, quality, simhash
from loomwork.llm._common import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, SF)
    assert good.columns == docs.columns
    score = {r.doc_id: r.predicted for r in quality.op9_quality(spark, SF).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in score.items() if p}

    single = stages["SimHash near-dedup"](spark, good, SF)
    rows = sorted(good.collect(), key=lambda r: r.doc_id)
    prints = [simhash.fingerprint_of(r.text) & (1 << 64) - 1 for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    assert {r.doc_id for r in single.collect()} == {rows[g].doc_id for g in set(group)}

    private = stages["PII"](spark, single, SF)
    assert private.columns == docs.columns and all(r.n_chars == len(r.text) for r in private.collect())
    again = pii.pseudonymise(private.select("doc_id", "text"), key=pii.key_of(spark))
    assert again.count() == private.count() == single.count()

    mixed = stages["mixing"](spark, private, SF)
    assert mixed.columns == docs.columns
    copies = mixed.groupBy("doc_id").count().toPandas()
    assert copies["count"].between(1, 2).all()

    packed = stages["best-fit packing"](spark, mixed, SF).toPandas()
    library = Tokenizer.from_file(tokenizer_path(corpus_pipeline.BYTE_BPE))
    want = []
    for r in mixed.collect():
        ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, packing.END_ID], "<u4")
        want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    assert packed.length.sum() == sum(w[1] for w in want)
    short = packed[packed.groupby("doc_id").piece.transform("max") == 0]
    assert set(map(tuple, short[["doc_id", "length", "ids_crc32"]].to_numpy().tolist())) <= set(want)


def test_run_returns_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.groupBy("sequence_id").sum("length").toPandas()["sum(length)"].max() <= 2048


def written(spark, docs, folder):
    """A folder with ``docs`` and labels for some of them, as the pipeline reads them."""
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1) for i in range(12)]  # one class: every document is kept
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_on_odd_rows(spark, clashing_docs, no_docs, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing names go through every stage with their columns."""
    sf = written(spark, clashing_docs, tmp_path / "odd")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == clashing_docs.columns, name
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and got.groupBy("sequence_id").sum("length").toPandas()["sum(length)"].max() <= 2048
    empty = written(spark, no_docs, tmp_path / "empty")
    assert corpus_pipeline.run(spark, empty).count() == 0
