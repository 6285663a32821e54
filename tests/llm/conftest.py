import pytest

#: Names like those of results and of helper columns, now or once.
HELPERS = ["_id", "_rows", "_hash", "_bucket", "_whole", "_found", "_new", "_score", "_key", "_range", "_next", "_old", "_copy"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, found int, score double"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns named like results and helpers."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    base = "the quick brown fox jumps over the lazy dog near the river bank at dawn today"
    texts = [None, "", base, base, base.upper(), long, "x", " \t\n ", "Ünïcödé 日本語 🙂 text", "word", "word", "a b c d e f"]
    rows = [
        (i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None, 1, None, 7, 0.5)
        for i, t in enumerate(texts)
    ]
    rows += [rows[2], rows[2], (None, "no id at all", None, None, None, None, None, None, None), (None,) * 9]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing_docs(spark, odd_docs):
    """``odd_docs`` with a column for each helper name; its values tell them apart."""
    from pyspark.sql import functions as F

    return odd_docs.select("*", *[F.concat(F.lit(f"own {c} "), F.coalesce("text", F.lit(""))).alias(c) for c in HELPERS])


@pytest.fixture(scope="session")
def unchanged():
    """Checks that a result holds the helper-named columns of its rows as they were; ``texts``: a text for each doc_id."""

    def check(got, docs):
        own = {r.doc_id: r for r in docs.collect()}
        rows = got.collect()
        for r in rows:
            for c in HELPERS:
                assert r[c] == (own[r.doc_id][c] if r.doc_id is not None else r[c]) and (r[c] is None or r[c].startswith(f"own {c}"))
        return rows

    return check


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
