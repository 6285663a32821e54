"""Chunks against a plain recursive splitter, and types of documents."""

import re

import pytest

from loomwork.functions import chunking as C
from loomwork.plans import chunking, structure

SF = "/root/testdata/sf0.001"


def tokens(text):
    return len([w for w in re.split(r"\s+", text, flags=re.A) if w]) * 4 // 3


def split(text, levels, size):
    if not levels:
        return [text[i : i + C.HARD] for i in range(0, len(text), C.HARD)]
    if tokens(text) <= size and len(text) <= 8 * size:
        return [text]
    return [q for p in re.split(levels[0], text, flags=re.A) for q in split(p, levels[1:], size)]


def plain(text, size=C.SIZE, levels=C.DOCUMENT_LEVELS):
    out, open_, held, at = [], "", 0, 0
    for piece in filter(None, split(text, levels, size)):
        n = tokens(piece)
        if held + n <= size and len(open_) + len(piece) <= 8 * size:
            open_, held = open_ + piece, held + n
        else:
            if open_:
                out.append((open_, held, at, at + len(open_)))
            at, open_, held = at + len(open_), piece, n
    return out + ([(open_, held, at, at + len(open_))] if open_ else [])


def test_chunks_against_a_plain_splitter(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in chunking.document_chunks(spark, SF).orderBy("doc_id", "chunk_index").collect():
        assert texts[r.doc_id][r.start_char : r.end_char] == r.content
        got.setdefault(r.doc_id, []).append((r.content, r.tokens, r.start_char, r.end_char))
    assert got == {d: kept for d, t in texts.items() if (kept := [c for c in plain(t) if c[1] >= 10])}


@pytest.mark.parametrize("size", [5, 40])
def test_odd_texts(spark, size):
    from pyspark.sql import functions as F

    texts = ["", " ", "one", "a" * 5000, "x. y! z? " * 60, "\n\n\n\n" + "para one\n\npara two\n" * 30, "no spaces;here,at:all" * 200, "ünïcödé 日本語 🙂 " * 50, "\t\tdef f():\n  pass\n\n\nclass A:\n" * 20]
    for levels in (C.DOCUMENT_LEVELS, C.CODE_LEVELS):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", C.chunks(F.col("t"), size, levels).alias("c"))
        for r in df.collect():
            assert [tuple(x) for x in r.c] == plain(texts[r.id], size, levels), (r.id, size)


def test_sizes_per_document(spark):
    per = {}
    for r in chunking.document_chunks(spark, SF).collect():
        per.setdefault(r.doc_id, []).append(r.tokens)
    got = {r.doc_id: (r.chunks, r.tokens, r["mean"]) for r in chunking.chunk_sizes(spark, SF).collect()}
    assert got == {d: (len(t), sum(t), sum(t) // len(t)) for d, t in per.items()}


def test_types_of_documents(spark):
    """Scores summed by hand from the marks of each text and its file name."""
    from pyspark.sql import functions as F

    from loomwork.operators.structure import classify, confidences

    cases = [
        ("From: a@b.org\nTo: c@d.org\nSubject: hi\n\nhello", "x.bin", "email", 1.0),  # 4 of the marks, the heads, two addresses
        ("Slide 1\n- a\n- b\nSlide 2\n- c", "talk.pptx", "presentation", 0.2 + 0.2 + 0.25),
        ("|a|b|\n|---|---|\n|1|2|\n|3|4|", "x.csv", "table", 0.08 + 0.2 + 0.12 + 0.15),
        ("Q: what?\nA: that\n" * 3, "faq.txt", "qa", 0.06 + 0.3 + 0.24 + 0.2),
        ("1. Background\nBackground\nSummary\nResults\n[1] and [2]", "thesis.pdf", "academic", None),
        ("plain words", "x.bin", "general", None),
        ("", "x.bin", "general", None),
    ]
    df = spark.createDataFrame([(t, f) for t, f, _, _ in cases], "t string, f string")
    scores = confidences(F.col("t"), F.col("f"))
    rows = classify(df, "t", F.col("f"), least=0.45).select("*", *[v.alias(f"s_{k}") for k, v in scores.items()]).collect()
    for r, (_, _, kind, score) in zip(rows, cases, strict=True):
        assert r.document_type == kind
        assert score is None or abs(r[f"s_{kind}"] - score) < 1e-9
    # One numbered section and one without a number: "Background" and "Summary" need theirs.
    assert abs(rows[4].s_academic - (0.05 + 0.1 + 2 * 0.1 + 0.04 + 0.15)) < 1e-9


def test_rendered_mails_are_mails(spark):
    found = {(r.made_as, r.document_type) for r in structure.classified(spark, SF).collect()}
    assert {t for m, t in found if m == "email"} == {"email"}


def test_rendered_code_is_estimated_once(spark):
    """The plan of a rendered text holds its expression once; many rows of code take seconds."""
    from loomwork.plans import chunking as plans

    plan = plans.code_chunks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("def f") == 1


def test_types_cut_lines_once(spark):
    """The lines of a text come from a generator, a column for all patterns that are counted by line."""
    from loomwork.operators.structure import classify
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([("a",)], "t string")
    plan = classify(docs, "t", F.lit("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "_lines" in plan
