"""Rendezvous hashing: a plain version, movement when shards change, weights, slots."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwork.llm import shards


def plain(key, weights):
    def bid(i):
        named = "n" if key is None else f"k{key}"
        u = (int(hashlib.md5(f"{named}@{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return weights[i] / -math.log(u), -i

    return max(range(len(weights)), key=bid)


def test_against_a_plain_version(spark):
    got = shards.op13_shards(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.shard == plain(r.doc_id, [1] * 8) and r.grown_shard == plain(r.doc_id, [1] * 9)
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        own = sorted((r.slot, r.doc_id) for r in got if r.shard == s)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own)


def test_few_records_move(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    rows = keys.select(*[shards.shard_of(F.col("doc_id"), w).alias(n) for n, w in (("a", [1.0] * 8), ("b", [1.0] * 9), ("c", [1.0] * 7 + [2.0]), ("d", [1.0] * 7 + [0.0]))]).collect()
    assert {r.b for r in rows if r.b != r.a} == {8}
    assert abs(sum(r.a != r.b for r in rows) / 20_000 - 1 / 9) < 0.01
    assert {r.c for r in rows if r.c != r.a} == {7}
    assert {r.a for r in rows if r.d != r.a} == {7} and all(r.d != 7 for r in rows)
    count = Counter(r.c for r in rows)
    assert abs(count[7] / 20_000 - 2 / 9) < 0.01 and all(abs(count[s] / 20_000 - 1 / 9) < 0.01 for s in range(7))


def test_odd_rows(spark, odd_docs, no_docs):
    named = odd_docs.selectExpr("*", "7 AS shard", "'mine' AS slot", "'own' AS folder", "1 AS at", "2 AS range", "'r' AS record")
    got = shards.shard_rows(named, "doc_id", [3.0, 1.0, 2.0]).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in odd_docs.collect())
    for r in got:
        assert (r.folder, r["at"], r.range, r.record) == ("own", 1, 2, "r")
        assert r.shard == plain(r.doc_id, [3.0, 1.0, 2.0]) and r.grown_shard is None
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert shards.shard_rows(no_docs, "doc_id", [1.0], 1.0).collect() == []
    for bad in ([], [1.0, -1.0]):
        with pytest.raises(ValueError, match="weight"):
            shards.shard_of(F.col("doc_id"), bad)


def test_a_hot_key_fills_several_ranges(spark):
    docs = spark.range(4000).selectExpr("CASE WHEN id % 3 > 0 THEN 11 ELSE id END AS doc_id", "id AS n")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = shards.shard_rows(docs, "doc_id", [1.0, 1.0], 1.0)
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(r.n for r in rows) == list(range(4000))
    for s in (0, 1):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_one_shard_is_one_folder(spark, tmp_path):
    docs = shards.with_shards(spark.range(300).withColumnRenamed("id", "doc_id"), "doc_id", [1.0] * 4)
    path = f"file://{tmp_path}/shards"
    shards.write_shards(docs, "doc_id", path)
    some = shards.read_shards(spark, path, docs, shards=[2])
    assert {r.shard for r in some.collect()} == {2}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder#\d+ = 2", plan)
