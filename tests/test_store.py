"""Partitioned tables: only touched folders are rewritten, and a writer that came between is noticed."""

import os

import pytest
from pyspark.sql.types import StructType

from loomwork.sources.store import Conflict, Store, delete_cascade, updated

SCHEMA = StructType().add("user_id", "long").add("doc_id", "long").add("content", "string").add("content_hash", "string").add("collection", "string")


@pytest.fixture
def store(spark, tmp_path):
    own = Store(spark, f"file://{tmp_path}/documents", "collection", SCHEMA)
    rows = [(u, 10 * u + d, f"text {u} {d}", "", c) for u in (1, 2) for d, c in enumerate(["a", "b/1", None, "a"])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("user_id", "doc_id", "content", "sha2(content, 256) AS content_hash", "collection")
    assert own.read().count() == 0 and own.version() == 0
    assert own.append(df) == 1
    return own


def files(store):
    root = store.path.removeprefix("file://") + "/rows"
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def ids(store):
    return sorted(r.doc_id for r in store.read().collect())


def test_a_deletion_rewrites_only_what_it_touches(spark, store):
    before = files(store)
    keys = spark.createDataFrame([(1, "a")], "user_id long, collection string")
    assert store.delete(keys) == 2 and ids(store) == [11, 12, 20, 21, 22, 23]
    assert {f for f in before if "collection=a" not in f} <= files(store)
    assert not {f for f in before if "collection=a" in f} & files(store)
    store.delete(spark.createDataFrame([(2,)], "user_id long"))
    assert ids(store) == [11, 12] and not any("collection=a" in f for f in files(store))
    store.delete(spark.createDataFrame([(1, None)], "user_id long, collection string"))
    assert ids(store) == [11]
    version = store.version()
    assert store.delete(spark.createDataFrame([(99,)], "user_id long")) == version == store.version()


def test_a_writer_that_came_between(spark, store):
    seen = store.version()
    store.append(store.read().filter("doc_id = 11").selectExpr("user_id", "doc_id + 100 AS doc_id", "content", "content_hash", "collection"))
    keys = spark.createDataFrame([(1,)], "user_id long")
    with pytest.raises(Conflict):
        store.delete(keys, expected=seen)
    assert len(ids(store)) == 9
    with pytest.raises(Conflict):
        store._take(store.version())
    store.delete(keys, expected=seen + 1)
    assert ids(store) == [20, 21, 22, 23]


def test_updates_and_their_conflicts(spark, store):
    h = {r.doc_id: r.content_hash for r in store.read().collect()}
    asked = [
        (1, "a", 10, h[10], "new ten"), (1, "a", 13, h[13], "new ten"), (1, "b/1", 11, "stale", "x"), (1, "a", 77, h[10], "x"), (2, "a", 20, h[20], "text 2 3"),
        (2, "a", 23, h[23], "text 2 3"), (2, None, 22, h[22], "null collection"),
    ]
    df = spark.createDataFrame(asked, "user_id long, collection string, doc_id long, expected_hash string, content string")
    got = {r.doc_id: r.status for r in updated(store, df).collect()}
    assert got == {10: "updated", 13: "duplicate", 11: "stale", 77: "missing", 20: "duplicate", 23: "updated", 22: "updated"}
    after = {r.doc_id: r.content for r in store.read().collect()}
    assert (after[10], after[13], after[20], after[22]) == ("new ten", "text 1 3", "text 2 0", "null collection") and len(after) == 8


def test_cascade(spark, store, tmp_path):
    chunks = Store(spark, f"file://{tmp_path}/chunks", "collection", StructType().add("user_id", "long").add("doc_id", "long").add("n", "integer").add("collection", "string"))
    chunks.append(store.read().selectExpr("user_id", "doc_id", "explode(array(1, 2)) AS n", "collection"))
    delete_cascade([store, chunks], spark.createDataFrame([("a", 10), (None, 22)], "collection string, doc_id long"))
    assert 10 not in ids(store) and 22 not in ids(store)
    assert sorted(r.doc_id for r in chunks.read().collect()) == sorted(2 * ids(store))
