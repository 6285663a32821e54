"""Combining result lists: reciprocal rank fusion, neighbour windows, overlaps, merging of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def reciprocal_rank(a: DataFrame, b: DataFrame, id_col: str, k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """(query_id, id, score, rrf, rank) of two ranked lists: ordered by summed reciprocal ranks, shown with the higher score.

    Ties go to the rank in the first list, then to that in the second.
    """
    left = a.select("query_id", id_col, F.col("rank").alias("rank_a"), F.col("score").alias("score_a"))
    right = b.select("query_id", id_col, F.col("rank").alias("rank_b"), F.col("score").alias("score_b"))
    both = left.join(right, ["query_id", id_col], "full_outer")
    part_a = F.coalesce(F.lit(1.0) / (constant + F.col("rank_a")), F.lit(0.0))
    part_b = F.coalesce(F.lit(1.0) / (constant + F.col("rank_b")), F.lit(0.0))
    fused = both.withColumn("rrf", part_a + part_b)
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.asc_nulls_last("rank_a"), F.asc_nulls_last("rank_b"), id_col)
    ranked = fused.withColumn("rank", F.row_number().over(order))
    ranked = ranked if k is None else ranked.filter(F.col("rank") <= k)
    return ranked.select("query_id", id_col, F.greatest("score_a", "score_b").alias("score"), "rrf", "rank")


def expand_windows(hits: DataFrame, chunks: DataFrame, before: int = 1, after: int = 2) -> DataFrame:
    """``hits`` (query_id, document, chunk_index, score, ...) with the text of their neighbours and the window's bounds.

    A hit is joined to the indexes it wants, so the band is an equi-join on (document, index).
    """
    wanted = hits.withColumn("at", F.explode(F.sequence(F.col("chunk_index") - before, F.col("chunk_index") + after)))
    near = wanted.join(chunks.select("document", F.col("chunk_index").alias("at"), "content"), ["document", "at"])
    text = F.transform(
        F.array_sort(F.collect_list(F.when(F.trim("content") != "", F.struct("at", F.trim("content").alias("c"))))), lambda x: x["c"]
    )
    merged = near.groupBy("query_id", "document", "chunk_index").agg(
        F.array_join(text, "\n\n").alias("expanded_content"),
        F.count(F.lit(1)).alias("chunks_merged"),
        F.max("at").alias("_last"),
    )
    joined = hits.join(merged, ["query_id", "document", "chunk_index"], "left")
    some = F.col("chunks_merged") > 1
    return (
        joined.withColumn("start_index", F.when(some, F.greatest(F.lit(0), F.col("chunk_index") - before)))
        .withColumn("end_index", F.when(some, F.least(F.col("chunk_index") + after, F.col("_last"))))
        .drop("_last")
    )


def drop_overlaps(hits: DataFrame) -> DataFrame:
    """Greedy by score: a window goes if it overlaps one kept before it in its document. Hits without a window stay.

    A query's hits in a document are few (at most its k), so the fold runs over one small array.
    """
    row = F.struct(*[F.col(c) for c in hits.columns])
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("chunk_index").alias("i"), row.alias("row"))))
    grouped = hits.groupBy("query_id", "document").agg(listed.alias("rows"))
    start = F.filter("rows", lambda x: F.lit(False))

    def step(kept, x):
        hit = F.exists(
            kept, lambda y: (y["row"]["start_index"] <= x["row"]["end_index"]) & (x["row"]["start_index"] <= y["row"]["end_index"])
        )
        return F.when(x["row"]["start_index"].isNotNull() & F.coalesce(hit, F.lit(False)), kept).otherwise(F.array_append(kept, x))

    return grouped.select(F.explode(F.aggregate("rows", start, step)).alias("x")).select("x.row.*")


def merge_sources(chunks: DataFrame, graph: DataFrame) -> DataFrame:
    """Chunk sources, best of each (document, chunk), then graph sources whose file no chunk source has; best score first.

    Where a graph source names the file of a chunk source, the higher score of the two stands.
    """
    best = chunks.groupBy("query_id", "document_id", "chunk_index").agg(
        F.max("score").alias("score"), F.max_by("filename", "score").alias("filename")
    )
    by_file = graph.groupBy("query_id", "filename").agg(F.max("score").alias("graph_score"))
    raised = best.join(by_file, ["query_id", "filename"], "left")
    raised = raised.select("query_id", "document_id", "chunk_index", "filename", F.greatest("score", F.coalesce("graph_score", "score")).alias("score"))
    new = graph.join(best.select("query_id", "filename").distinct(), ["query_id", "filename"], "left_anti")
    new = new.groupBy("query_id", "document_id", "chunk_index").agg(F.max_by("filename", "score").alias("filename"), F.max("score").alias("score"))
    return raised.unionByName(new)
