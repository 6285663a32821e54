"""A graph's edges are dropped by a filter."""

from loomwork.operators import graph


def test_drop_joins_nothing_and_deletes_only_its_rows(spark, tmp_path, monkeypatch):
    rows = [(u, c, "a", b, 1) for u in (1, 2) for c in ("x", "y", None) for b in "pq"]
    edges = spark.createDataFrame(rows, "user_id long, collection string, a string, b string, weight long")
    path = f"file://{tmp_path}/graph"
    graph.save(edges, path)
    # Joins would bring all edges of a collection to one task.
    monkeypatch.setattr(type(edges), "join", None)
    graph.drop(spark, path, 1, "x")
    left = lambda: sorted({(r.user_id, r.collection or "") for r in graph.load(spark, path).collect()})
    assert left() == [(1, ""), (1, "y"), (2, ""), (2, "x"), (2, "y")]
    graph.drop(spark, path, 2)
    assert left() == [(1, ""), (1, "y")] and graph.load(spark, path).count() == 4
    graph.drop(spark, path, 3)
    assert left() == [(1, ""), (1, "y")]
