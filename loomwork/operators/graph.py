"""An entity graph: long terms as entities, their co-occurrence in a line as weighted edges, kept apart by collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwork.functions.analysis import terms
from loomwork.session import spread, staged
from loomwork.sources.store import Store

MIN_LETTERS = 9
MIN_DOCUMENTS = 2


def mentions(docs: DataFrame, id_col: str, collection: str, text: str) -> DataFrame:
    """(collection, id, line, entity): distinct long terms of each line."""
    lines = spread(docs).select(id_col, F.col(collection).alias("collection"), F.posexplode(F.split(text, "\n")).alias("line", "t"))
    found = F.array_distinct(F.filter(terms(F.col("t")), lambda w: F.length(w) >= MIN_LETTERS))
    return lines.select(id_col, "collection", "line", F.explode(found).alias("entity"))


def build(docs: DataFrame, id_col: str, collection: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(entities, edges). An entity occurs in at least two documents (rows) of its collection.

    A document counts once for an entity inside its own row; mentions of kept entities are put back into their lines, and
    pairs are made within one line from its own array and summed before the shuffle. A line of m entities has m (m - 1) / 2
    pairs: what is a line bounds them, so texts without line breaks should be cut into sentences first.
    """
    found = staged(mentions(docs, id_col, collection, text), "mentions")
    per_doc = found.select("collection", id_col, "entity").distinct()
    entities = per_doc.groupBy("collection", "entity").agg(F.count(F.lit(1)).alias("documents"))
    entities = entities.filter(F.col("documents") >= MIN_DOCUMENTS)
    kept = found.join(entities.select("collection", "entity"), ["collection", "entity"])
    listed = kept.groupBy("collection", id_col, "line").agg(F.array_sort(F.collect_list("entity")).alias("e"))
    pairs = listed.filter(F.size("e") > 1).select("collection", F.explode("e").alias("a"), "e")
    pairs = pairs.select("collection", "a", F.explode(F.filter("e", lambda x: x > F.col("a"))).alias("b"))
    edges = pairs.groupBy("collection", "a", "b").agg(F.count(F.lit(1)).alias("weight"))
    return entities, edges.withColumnRenamed("collection", collection)


def _best(found: DataFrame, k: int, keys: list[str]) -> DataFrame:
    others = [c for c in found.columns if c not in ("weight", "a", "b", "rank", *keys)]
    order = Window.partitionBy(*keys).orderBy(F.desc("weight"), *others, "a", "b")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _asked(queries: DataFrame) -> DataFrame:
    named = F.array_distinct(F.filter(terms(F.col("query")), lambda w: F.length(w) >= MIN_LETTERS))
    return queries.select("query_id", F.explode(named).alias("entity"))


MODES = ("local", "global", "hybrid", "naive")


def search(
    entities: DataFrame, edges: DataFrame, queries: DataFrame, k: int, mode: str = "local", collection: str = "source", hits: DataFrame | None = None
) -> DataFrame:
    """(query_id, edge, rank): references for each query, k at most.

    Local: the heaviest edges at the entities that a query names. Global: the heaviest edges of the collections that know
    any of them. Hybrid: the best of both. Naive: no graph, the ``hits`` of a search among chunks.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if mode == "naive":
        return hits.filter(F.col("rank") <= k)
    asked = _asked(queries)
    found = []
    if mode != "global":
        ends = edges.withColumn("entity", F.explode(F.array("a", "b")))
        found.append(asked.join(ends, "entity").drop("entity").distinct())
    if mode != "local":
        # The k best of a collection hold whatever a query can get from it, so queries never meet all edges.
        known = asked.join(entities.select("entity", F.col("collection").alias(collection)), "entity").select("query_id", collection).distinct()
        found.append(known.join(_best(edges, k, [collection]).drop("rank"), collection))
    columns = ["query_id", *edges.columns]
    every = found[0].select(*columns) if len(found) == 1 else found[0].select(*columns).unionByName(found[1].select(*columns)).distinct()
    return _best(every, k, ["query_id"])


EDGES = StructType().add("user_id", "long").add("a", "string").add("b", "string").add("weight", "long").add("collection", "string")


def _store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, "collection", EDGES)


def save(edges: DataFrame, path: str) -> None:
    """Append edges (user_id, collection, a, b, weight) to the graph at ``path``, a folder for each collection."""
    _store(edges.sparkSession, path).append(edges)


def drop(spark: SparkSession, path: str, user_id: int, collection: str | None = None) -> None:
    """Delete a user's collection, or all of them: folders that hold edges of the user are written anew without these."""
    gone = F.col("user_id") == user_id
    _store(spark, path).delete_where(gone if collection is None else gone & (F.col("collection") == collection))


def load(spark: SparkSession, path: str) -> DataFrame:
    return _store(spark, path).read()
