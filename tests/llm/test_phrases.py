"""Collocations against a plain count of every sequence."""

import re
from collections import Counter

import pytest

from loomwork.llm import phrases
from loomwork.llm._common import staged


def plain(docs, min_count=10, cover=50, top=2000):
    f, n = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})
        own = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        rows, cands = [], {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        for p, a in cands.items():
            if any(len(q) > len(p) and p in {q[:2], q[1:]} and 100 * b >= cover * a for q, b in cands.items()):
                continue
            cuts = [(1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def test_against_a_plain_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang")
    texts = [tuple(r) for r in docs.collect()]
    assert found(docs, min_count=5, top=50) == plain(texts, 5, top=50)
    assert found(docs, min_count=3, cover_percent=90, top=7) == plain(texts, 3, 90, 7)


def test_odd_texts(spark, odd_docs, clashing_docs, no_docs):
    want = plain([(r.text, r.lang) for r in odd_docs.collect()], 2)
    assert want and found(odd_docs, min_count=2) == want and found(clashing_docs, min_count=2) == want
    assert found(no_docs) == []


def test_pieces_words_and_repeats(spark):
    texts = ["a a a a", "A\ta  a , a\x0bb\x1fc b\x1fc.. b\x1fc!Ä ä", "x y. x y; x y z", None, "", " ,;. \n", "x y z x y z"] * 3
    docs = spark.createDataFrame([(t, None if i % 2 else "und") for i, t in enumerate(texts)], "text string, lang string")
    pieces = {r.piece: r.m for r in phrases.pieces_of(docs).collect()}
    assert pieces["a a a a"] == 3 and pieces["a a a"] == 3 and pieces["x y"] == 6 and pieces["b\x1fc"] == 3
    assert all(p == " ".join(p.split(" ")) and p for p in pieces)
    for least in (1, 2, 6):
        assert found(docs, min_count=least) == plain([(t, "und") for t in texts], least)


def test_small_chunks_and_buckets_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang")
    want = found(docs)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 3000)
    assert want and found(docs) == want


def test_products_beyond_64_bits(spark):
    a, n = 3_000_000_000_000, 4_000_000_000_000
    rows = [("en", "big one", a), ("en", "big", n), ("en", "one", n + 1)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, f long")).collect()
    assert [(r.l, r.r, r.score) for r in got] == [(n, n + 1, 1_000_000 * a * a // (n * (n + 1)))]


def test_a_hot_word_and_its_phrases(spark):
    texts = [f"the w{i % 40} of the w{i % 7}" for i in range(2000)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    pieces = staged(phrases.pieces_of(docs), "pieces")
    assert pieces.count() < len(texts)
    assert found(docs) == plain([(t, "en") for t in texts])


@pytest.mark.parametrize("top", [1, None])
def test_top(spark, top):
    docs = spark.createDataFrame([("p q r, s t, p q", "en")] * 12, "text string, lang string")
    assert found(docs, top=top) == plain([("p q r, s t, p q", "en")] * 12, top=top or 10**9)
