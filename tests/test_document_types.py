"""Marks of document types are counted by the batch, as Java's regular expressions find them row by row."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from loomwork.functions import patterns as P
from loomwork.operators import document_types as D
from loomwork.operators.structure import classify
from loomwork.plans import structure

ODD = ["\n", "\r\n", "\r", "\u0085", " ", "\x0b", "\x0c", "ſ", "K", "İ", "é", "é1", "á", "́", "日", "_", "1", " ", "  ", ".", ",", "-", "|", ":", "#", "(", ")", "[1]", "•"]
WORDS = ["Section 4", "breach", "court", "doi: 1", "doi:1doi:2/", "et al.", "fig 3", "results", "(Smith, 2020)", "Q:", "A", "q12.", "frequently\nasked", "|a|b|", "|--|", "chapter iv", "index", "From:", "a@b.org", "sent:", "sKills", "Slide 4", "Setup", "1. Introduction", "Step 2. go", "NOTE: x"]


def texts():
    rng = random.Random(7)
    return ["".join(rng.choice(ODD if rng.random() < 0.6 else WORDS) for _ in range(rng.randint(0, 40))) for _ in range(400)]


def test_batches_count_what_java_counts(spark):
    made = [t.replace("\u017f", "\u00e9").replace("\u212a", "\ue001") for t in texts()]
    df = spark.createDataFrame([(t,) for t in texts()], "t string")
    whole, led, words = pa.array(made), pa.array(["\n" + t for t in made]), D._words(pa.array(made))
    bounded = [p for p in P.ACADEMIC_INDICATORS if r"\b" in p and "doi" not in p]
    groups = [
        (led, [P.LEGAL_INDICATORS[-1], r"(?m)^\s*\|.+\|", P.QA_FORMAT, *P.EMAIL_INDICATORS, *("(?m)" + p for p in P.RESUME_SECTIONS.values())]),
        (words, [*P.LEGAL_INDICATORS[:-1], *bounded]),
        (whole, [*(p for p in P.ACADEMIC_INDICATORS if r"\b" not in p), P.RESUME_EMAIL, P.RESUME_PHONE]),
    ]
    for given, patterns in groups:
        want = df.select(*[F.regexp_count("t", F.lit(p)).alias(f"n{i}") for i, p in enumerate(patterns)]).toPandas()
        for i, (p, got) in enumerate(zip(patterns, D._each(given, tuple(patterns)), strict=True)):
            assert got.tolist() == want[f"n{i}"].tolist(), p


def test_lines_start_as_in_java(spark):
    made = [t.replace("\u017f", "\u00e9").replace("\u212a", "\ue001") for t in texts()]
    cut = D._Lines(pa.array([t.split("\n") for t in made]))
    lines = F.transform(F.split("t", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    df = spark.createDataFrame([(t,) for t in texts()], "t string").select(lines.alias("l"))
    count = lambda p: F.size(F.filter(F.slice("l", 1, 3), lambda x: x.rlike(p)))
    want = df.select(*[count(p).alias(f"n{i}") for i, p in enumerate(D._OF_LINES)]).toPandas()
    for i, p in enumerate(D._OF_LINES):
        assert cut.count(p, 3).tolist() == want[f"n{i}"].tolist(), p


def test_no_pattern_is_searched_row_by_row(spark):
    df = spark.createDataFrame([("From: a@b.org\nTo: c@d.org\nSubject: hi",), (None,), ("",)], "t string")
    found = classify(df, "t", F.lit(None).cast("string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rlike" not in plan and "regexp" not in plan
    # A text that isn't there has no marks; it used to have all of them.
    assert [r.document_type for r in found.collect()] == ["email", "general", "general"]


def test_mails_of_one_row_group_are_dealt_over_the_cores(spark):
    plan = structure.classified(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    orders = next(x for x in plan.split("Union") if "o_orderdate" in x)
    assert any("Repartition" in part for part in orders.split("Join")[1:])
