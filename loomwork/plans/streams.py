"""Registered streaming queries, run over the driver's tables and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.chunking import SIZE
from loomwork.plans.text import clean_sql
from loomwork.streaming import jobs


def ingestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingested chunks of each document, put together again: its cleaned text, the longest chunk, the searched text's end."""
    stream = jobs.ingest(jobs.read_stream(spark, f"{sf_dir}/documents.parquet"))
    rows = jobs.run(stream, partition_by=["lang"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"])
    return rows.groupBy("doc_id", "lang", "content_hash").agg(
        F.md5(F.array_join(listed, "")).alias("cleaned"), (F.max("tokens") <= SIZE).alias("fits"), F.max(F.length("search_content") > 0).alias("searched")
    )


def idempotent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run(jobs.first_contents(jobs.read_stream(spark, f"{sf_dir}/documents.parquet")))


def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = jobs.run(jobs.rate_windows(jobs.read_stream(spark, f"{sf_dir}/events.parquet")), "update", key=["user_id", "start"])
    return table.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "calls")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that no event can lengthen any more, a day behind the last event."""
    table = jobs.run(jobs.sessions(jobs.read_stream(spark, f"{sf_dir}/events.parquet")))
    return table.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run(jobs.statuses(jobs.read_stream(spark, f"{sf_dir}/events.parquet")), "update", key=["user_id"])


QUERIES = {
    "x1_ingestion": ingestion,
    "x2_idempotent_keys": idempotent_keys,
    "x3_statuses": statuses,
    "x4_rate_windows": rate_windows,
    "x5_sessions": sessions,
}
ORACLES = {
    "x1_ingestion": f"""
        WITH c AS (SELECT doc_id, lang, text, {clean_sql("text")} AS t FROM documents)
        SELECT doc_id, lang, sha256(text) AS content_hash, md5(t) AS cleaned, true AS fits, regexp_matches(t, '[^\\s/_-]') AS searched FROM c""",
    "x2_idempotent_keys": "SELECT DISTINCT sha256(text) AS content_hash FROM documents",
    "x3_statuses": """
        SELECT user_id, list_reduce(list(event_type ORDER BY event_id), lambda s, e: CASE s || '>' || e WHEN 'pending>view' THEN 'processing' WHEN 'processing>purchase' THEN 'completed'
                 WHEN 'processing>error' THEN 'failed' WHEN 'failed>click' THEN 'pending' ELSE s END, 'pending') AS status, count(*) AS events FROM events GROUP BY user_id""",
    "x4_rate_windows": "SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS calls FROM events GROUP BY 1, 2",
    "x5_sessions": """
        WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k
        HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
}
