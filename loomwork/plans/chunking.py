"""Registered chunking queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import chunking as C
from loomwork.functions.text import token_estimate
from loomwork.session import spread, table


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chunk_index, content, tokens, start_char, end_char) without chunks of fewer than ten tokens, numbered anew."""
    docs = spread(table(spark, sf_dir, "documents"))
    pieces = docs.select("doc_id", F.posexplode(C.chunks(F.col("text"))).alias("at", "c")).select("doc_id", "at", "c.*")
    kept = pieces.filter("tokens >= 10")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    return kept.select("doc_id", index.alias("chunk_index"), "content", "tokens", "start_char", "end_char")


def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, tokens and their whole mean per document."""
    per = document_chunks(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tokens").alias("tokens"))
    return per.withColumn("mean", F.floor(F.col("tokens") / F.greatest("chunks", F.lit(1))))


def lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of a document, joined: its text, none above the size, each where its offsets say."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text", C.chunks(F.col("text")).alias("c"))
    found = F.forall("c", lambda x: F.substr("text", x["start_char"] + 1, x["end_char"] - x["start_char"]) == x["content"])
    joined = F.array_join(F.transform("c", lambda x: x["content"]), "")
    return docs.select("doc_id", F.md5(joined).alias("h"), (F.coalesce(F.array_max(F.transform("c", lambda x: x["tokens"])), F.lit(0)) <= C.SIZE).alias("fits"), found.alias("in_place"))


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of rendered source code: none is lost, and definitions begin chunks where they don't fit together."""
    code = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.col("p_size") % 7 + 1), lambda i: F.concat(F.lit("\n\ndef f"), i.cast("string"), F.lit("():\n"), F.repeat(F.lit("    x = 1 + 2 + 3\n"), 40))))

    def whole(text: Column) -> Column:
        return F.md5(F.array_join(F.transform(C.chunks(text, levels=C.CODE_LEVELS), lambda x: x["content"]), "")) == F.md5(text)

    # The text is made once for both digests.
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    return parts.select("p_partkey", F.element_at(F.transform(F.array(code), whole), 1).alias("whole"))


def token_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("source", token_estimate(F.col("text")).alias("tokens"))
    per = docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("total_tokens"))
    return per.withColumn("mean", F.floor(F.col("total_tokens") / F.greatest("documents", F.lit(1))))


QUERIES = {
    "c1_c2_w2_chunks": document_chunks,
    "c1_lossless": lossless,
    "c4_code_chunks": code_chunks,
    "a3_a4_chunk_sizes": chunk_sizes,
    "a3_a4_a16_token_sums": token_sums,
}
ORACLES = {
    "c1_lossless": "SELECT doc_id, md5(text) AS h, true AS fits, true AS in_place FROM documents",
    "c4_code_chunks": "SELECT p_partkey, true AS whole FROM part",
    "a3_a4_a16_token_sums": """
        WITH t AS (SELECT source, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 4 // 3 AS n FROM documents)
        SELECT source, count(*) AS documents, sum(n)::BIGINT AS total_tokens, (sum(n) // count(*))::BIGINT AS mean FROM t GROUP BY source""",
}
