"""Keyword search over postings: all query lexemes must occur; BM25, mapped to (0, 1) by s / (1 + s).

A query set's postings are one written table: a row for each document with its length and the counts of those of its
lexemes that any query has. The corpus is read and split into terms once; document frequencies, the mean length and the
scores come from that table. Only terms that begin like a query's lexeme are stemmed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.analysis import counted, lexemes, stem, terms
from loomwork.operators.vector import top_k
from loomwork.session import spread, staged

K1, B = 1.2, 0.75


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n_terms): distinct lexemes of each query."""
    split = queries.select("query_id", F.array_distinct(lexemes(F.col("query"))).alias("t"))
    return split.select("query_id", F.size("t").alias("n_terms"), F.explode("t").alias("term"))


def postings(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, length, lexemes): of each document, the counts (x, n) of lexemes that begin like one of a query."""
    heads = query_terms(queries).select(F.substring("term", 1, 3).alias("head")).distinct()
    # Three letters or digits: at most 48,000 of them, whatever the number of queries.
    wanted = [r["head"] for r in heads.collect()]
    split = spread(docs.select(id_col, text_col)).select(id_col, terms(F.col(text_col)).alias("t"))
    near = F.filter("t", lambda w: F.substring(w, 1, 3).isin(wanted))
    held = split.select(id_col, F.size("t").alias("length"), counted(F.transform(near, stem)).alias("lexemes"))
    return staged(held, "postings")


def held_terms(posted: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """(id, length, term, tf) of the lexemes that are wanted."""
    rows = posted.select(id_col, "length", F.explode("lexemes").alias("p"))
    rows = rows.select(id_col, "length", F.col("p.x").alias("term"), F.col("p.n").alias("tf"))
    return rows.join(wanted.select("term").distinct(), "term", "left_semi")


def keyword_scores(
    docs: DataFrame, queries: DataFrame, id_col: str, text_col: str = "text", posted: DataFrame | None = None
) -> DataFrame:
    """(query_id, id, score) of documents that hold all lexemes of a query.

    A lexeme's postings meet the queries that have it, and rows are counted per (query, document). The score is rounded so
    that ties don't depend on the order of a sum.
    """
    wanted = query_terms(queries)
    posted = postings(docs, queries, id_col, text_col) if posted is None else posted
    held = held_terms(posted, wanted, id_col)
    totals = posted.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    # One row of totals: the only side that is broadcast by name.
    idf = df.crossJoin(F.broadcast(totals)).select("term", weight.alias("idf"), "mean")
    matched = held.join(wanted, "term").join(idf, "term")
    per = matched.groupBy("query_id", id_col).agg(
        F.count(F.lit(1)).alias("n"), F.first("n_terms").alias("n_terms"), F.sum(F.col("idf") * tf).alias("s")
    )
    return per.filter("n = n_terms").select("query_id", id_col, F.round(F.col("s") / (1 + F.col("s")), 9).alias("score"))


def keyword_search(docs: DataFrame, queries: DataFrame, id_col: str, k: int, threshold: float, text_col: str = "text") -> DataFrame:
    best = top_k(keyword_scores(docs, queries, id_col, text_col), id_col, k)
    return best.filter(F.col("score") >= threshold)


def term_coverage(hits: DataFrame, docs: DataFrame, queries: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``hits`` with rerank_score: the share of a query's idf that its document's lexemes cover, 0 to 1."""
    hits = staged(hits, "hits")  # read twice below
    wanted = query_terms(queries)
    posted = postings(docs, queries, id_col, text_col)
    held = held_terms(posted, wanted, id_col)
    total = posted.agg(F.count(F.lit(1)).alias("docs"))
    df = wanted.select("term").distinct().join(held.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term", "left")
    idf = df.crossJoin(F.broadcast(total)).select("term", F.log(1 + (F.col("docs") + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)).alias("idf"))
    weighed = wanted.join(idf, "term")
    whole = weighed.groupBy("query_id").agg(F.sum("idf").alias("whole"))
    got = hits.select("query_id", id_col).join(weighed, "query_id").join(held.select(id_col, "term"), [id_col, "term"])
    got = got.groupBy("query_id", id_col).agg(F.sum("idf").alias("got"))
    scored = hits.join(whole, "query_id", "left").join(got, ["query_id", id_col], "left")
    score = F.round(F.coalesce(F.col("got") / F.col("whole"), F.lit(0.0)), 9)
    return scored.withColumn("rerank_score", score).drop("whole", "got")
