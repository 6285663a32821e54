"""The whole retrieval request: base search, graph references, limit, context windows, reranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators import fusion, graph, lexical, twotier
from loomwork.operators.vector import top_k_semantic

SEMANTIC_THRESHOLD, KEYWORD_THRESHOLD, RERANK_THRESHOLD = 0.35, 0.001, 0.3
MODES = ("semantic", "keyword", "hybrid", "graph")


@dataclass
class Corpus:
    """``chunks``: id, document, chunk_index, content, embedding, metadata (JSON). ``documents``: document, embedding,
    processing_info (JSON); for the two-tier search. ``entities``, ``edges``: a graph as ``graph.build`` makes it."""

    chunks: DataFrame
    documents: DataFrame | None = None
    entities: DataFrame | None = None
    edges: DataFrame | None = None


@dataclass
class Request:
    mode: str = "hybrid"
    k: int = 10
    hierarchical: bool = False
    document_type: str | None = None
    enable_graph: bool = False
    expand_context: bool = False
    merge_overlapping: bool = True
    #: (hits with query_id, id and text; queries) -> hits with rerank_score.
    rerank: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    digits: int | None = None
    #: What zero vectors score, as in ``top_k_semantic``.
    nan: bool = False


def base_search(corpus: Corpus, queries: DataFrame, request: Request) -> DataFrame:
    """(query_id, id, score, rank) by mode. The type of a document is a chunk's in the plain modes and the document's in
    the two-tier search, as each of them knows it."""
    chunks, k = corpus.chunks, request.k
    if request.hierarchical:
        documents = corpus.documents
        if request.document_type:
            documents = documents.filter(F.get_json_object("processing_info", "$.domain_processor") == request.document_type)
        return twotier.search(documents, chunks, queries, k, request.mode, digits=request.digits, nan=request.nan).drop("document")
    if request.document_type:
        chunks = chunks.filter(F.get_json_object("metadata", "$.document_type") == request.document_type)
    n = 2 * k if request.mode == "hybrid" else k
    lists = []
    if request.mode != "keyword":
        lists.append(top_k_semantic(chunks, queries, "id", n, SEMANTIC_THRESHOLD, digits=request.digits, nan=request.nan))
    if request.mode != "semantic":
        lists.append(lexical.keyword_search(chunks, queries, "id", n, KEYWORD_THRESHOLD, "content"))
    found = lists[0] if request.mode != "hybrid" else fusion.reciprocal_rank(*lists, "id", k)
    return found.select("query_id", "id", "score", "rank")


def retrieve(corpus: Corpus, queries: DataFrame, request: Request) -> tuple[DataFrame, DataFrame | None]:
    """(hits, graph references) of ``queries`` (query_id, query, query_embedding).

    Hits: query_id, id, document, chunk_index, content, score, rank and, as the request asks, the window's expanded_content,
    start_index, end_index, chunks_merged, and rerank_score. In graph mode there are references alone. The limit holds after
    fusion and graph; windows come before reranking, which reads a window's text, by the query as it was asked.
    """
    if request.mode not in MODES:
        raise ValueError(f"no such mode: {request.mode}")
    wants_graph = request.mode == "graph" or request.enable_graph
    if wants_graph and corpus.edges is None:
        raise ValueError("a graph is asked for, but the corpus has none")
    references = graph.search(corpus.entities, corpus.edges, queries, request.k) if wants_graph else None
    place = corpus.chunks.select("id", "document", "chunk_index", "content")
    if request.mode == "graph":
        none = place.crossJoin(F.broadcast(queries.select("query_id").limit(0)))
        return none.select("query_id", "id", "document", "chunk_index", "content", F.lit(0.0).alias("score"), F.lit(0).alias("rank")), references
    hits = base_search(corpus, queries, request).filter(F.col("rank") <= request.k).join(place.drop("content"), "id")
    if request.expand_context:
        hits = fusion.expand_windows(hits, place)
        hits = fusion.drop_overlaps(hits) if request.merge_overlapping else hits
    hits = hits.join(place.select("id", "content"), "id")
    if request.rerank:
        text = F.coalesce(F.col("expanded_content"), F.col("content")) if request.expand_context else F.col("content")
        scored = request.rerank(hits.withColumn("text", text), queries).drop("text")
        order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "id")
        kept = scored.filter(F.col("rerank_score") >= RERANK_THRESHOLD).withColumn("rank", F.row_number().over(order))
        hits = kept.filter(F.col("rank") <= request.k)
    return hits, references


def coverage(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """A reranker without a model: the share of the query's weight that the lexemes of a hit's own text cover."""
    texts = hits.select(F.struct("query_id", "id").alias("hit"), "text")
    asked = hits.select("query_id", "id").join(queries.select("query_id", "query"), "query_id")
    asked = asked.select(F.struct("query_id", "id").alias("hit"), "query")
    wanted = asked.select("hit", F.explode(F.array_distinct(lexical.lexemes(F.col("query")))).alias("term"))
    held = texts.select("hit", F.explode(F.array_distinct(lexical.lexemes(F.col("text")))).alias("term"), F.lit(1).alias("has"))
    both = wanted.join(held, ["hit", "term"], "left")
    shares = both.groupBy("hit").agg(F.round(F.sum(F.coalesce("has", F.lit(0))) / F.count(F.lit(1)), 9).alias("rerank_score"))
    shares = shares.select("hit.query_id", "hit.id", "rerank_score")
    return hits.join(shares, ["query_id", "id"], "left").fillna(0.0, ["rerank_score"])
