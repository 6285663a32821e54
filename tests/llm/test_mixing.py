import re

import duckdb
from pyspark.sql import functions as F

from loomwork.llm import mixing

SF = "/root/testdata/sf0.001"


def water_fill(sizes, weights, share, epochs):
    """Clamp and deal the excess again until no source is above its cap."""
    budget = share * sum(sizes)
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = budget - sum(target[i] for i in range(len(sizes)) if i not in open_)
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > epochs * sizes[i]}
        for i in open_:
            target[i] = epochs * sizes[i] if i in over else left * weights[i] / total
        if not over:
            break
        open_ -= over
    return target


def test_targets_are_the_fixed_point(spark):
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 400, "e": 0, None: 700}
    rows = [(f"k{s}", s, n) for s, n in sizes.items()]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "_key string, source string, size long")).collect()}
    names = ["a", "b", "c", "d", "e", None]
    want = water_fill([sizes[s] for s in names], [3, 1, 2, 3, 1, 2], 1.5, 2)
    assert all(abs(got[s] - w) < 1e-6 for s, w in zip(names, want, strict=True))


def test_taken_is_near_target_and_reruns_agree(spark):
    a = mixing.op1_mix_sources(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    b = mixing.op1_mix_sources(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert a.equals(b)
    assert (a.taken <= 2 * a["size"]).all()
    per = a.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"))
    assert ((per.taken - per.target).abs() <= per.largest / 2 + 1).all()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.sql(mixing.OP1_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert (want.taken == a.taken).all() and (want.target == a.target).all()


def test_odd_rows(spark, odd_docs, no_docs):
    got = mixing.mix_sources(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.taken == r.repeats * r["size"] and 0 <= r.repeats <= 2
    mixed = mixing.mix_sources(odd_docs)
    assert mixing.repeated(mixed, odd_docs.columns).count() == mixed.agg(F.sum("repeats")).first()[0]
    assert mixing.mix_sources(no_docs).count() == 0


def test_helper_names(clashing_docs, unchanged):
    got = mixing.mix_sources(clashing_docs)
    assert len(unchanged(got, clashing_docs)) == clashing_docs.count()
    mixed = mixing.mixed_documents(clashing_docs)
    assert mixed.columns == clashing_docs.columns
    assert {r["size"] for r in unchanged(mixed, clashing_docs)} <= {1, None}
