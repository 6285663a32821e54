"""Two-tier search: the nearest documents of a query first, then chunks of those documents only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import fusion, lexical
from loomwork.operators.vector import cosine, top_k, top_k_semantic

MULTIPLIER = 3
#: Scores below these are dropped after the limit of their list.
SEMANTIC_THRESHOLD, KEYWORD_THRESHOLD = 0.30, 0.01
MODES = ("semantic", "keyword", "hybrid")


def mean_vectors(vectors: DataFrame, key: str, dimensions: int, vector_col: str = "embedding") -> DataFrame:
    """(key, embedding): the mean vector of each key, one average a dimension, combined before the shuffle."""
    means = [F.avg(F.get(vector_col, F.lit(i)).cast("double")) for i in range(dimensions)]
    return vectors.groupBy(key).agg(F.array(*means).alias("embedding"))


def check_mode(mode: str, queries: DataFrame) -> None:
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    if mode != "semantic" and ("query" not in queries.columns or not queries.filter(F.col("query").isNull()).isEmpty()):
        raise ValueError(f"mode {mode} needs a query text")


def search(
    documents: DataFrame,
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    mode: str = "semantic",
    multiplier: int = MULTIPLIER,
    id_col: str = "id",
    text_col: str = "content",
    digits: int | None = None,
    nan: bool = False,
) -> DataFrame:
    """(query_id, document, id, score, rank) of chunks in the ``k * multiplier`` documents nearest to each query.

    ``documents`` has document and embedding (without one it is never found), ``chunks`` document, the id, embedding and
    text, ``queries`` query_id, query_embedding and, for modes with keywords, query. A query whose first tier is empty has
    no result. ``nan``: what zero vectors score, as in ``top_k_semantic``.
    """
    check_mode(mode, queries)
    tier1 = top_k_semantic(documents, queries, "document", k * multiplier, None, digits=digits, nan=nan).select("query_id", "document")
    n = k if mode != "hybrid" else 2 * k
    lists = []
    if mode != "keyword":
        # A query's chunks are those of its documents: an equi-join, never all chunks.
        held = chunks.filter(F.col("embedding").isNotNull()).join(tier1, "document")
        held = held.join(queries.select("query_id", "query_embedding"), "query_id")
        score = cosine(F.col("embedding"), F.col("query_embedding"), nan)
        scored = held.select("query_id", "document", id_col, (score if digits is None else F.round(score, digits)).alias("score"))
        lists.append(top_k(scored, id_col, n).filter(F.col("score") >= SEMANTIC_THRESHOLD))
    if mode != "semantic":
        scores = lexical.keyword_scores(chunks, queries, id_col, text_col).join(chunks.select(id_col, "document"), id_col)
        scored = scores.join(tier1, ["query_id", "document"], "left_semi")
        lists.append(top_k(scored, id_col, n).filter(F.col("score") >= KEYWORD_THRESHOLD))
    if mode != "hybrid":
        return lists[0].select("query_id", "document", id_col, "score", "rank")
    fused = fusion.reciprocal_rank(*lists, id_col, k)
    return fused.join(chunks.select(id_col, "document"), id_col).select("query_id", "document", id_col, "score", "rank")
