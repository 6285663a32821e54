"""Structured Streaming jobs: ingestion, idempotent keys, a document's status, rate windows, session activity.

Each job reads a folder or file as a stream, runs until what is there is done (``availableNow``) and leaves a table in the
shared folder, so that its result can be compared with that of the batch query. On a cluster the same queries run with
another trigger. State is keyed, and a watermark ends it in every job that has one: a content is known for a week of
ingestion, a window until it can't change any more, a session until it is closed, a status until its key is idle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwork.functions.chunking import chunks
from loomwork.functions.text import rag_clean, search_normal
from loomwork.session import new_folder


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder as a stream. The source takes a single file only as the match of a pattern."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run(
    stream: DataFrame, mode: str = "append", partition_by: list[str] | None = None, key: list[str] | None = None
) -> DataFrame:
    """Run a streaming query over what there is; the table it leaves. An ``update`` query gives the last row per ``key``."""
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/table")
        writer = writer.partitionBy(*partition_by) if partition_by else writer
    else:
        # Each batch has a folder of its own for the rows that it changed, which a second run of the batch overwrites.
        writer = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/table/batch={n}"))
    writer.start().awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{folder}/table")
    changes = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/table")
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in key]), "batch").alias("row"))
    return last.select(*key, "row.*").select(*stream.columns)


def ingest(documents: DataFrame) -> DataFrame:
    """A row for each chunk of the cleaned texts: its content, the form that is searched, its size and the text's hash.

    An empty text has one empty chunk, so that no document is lost.
    """
    cut = chunks(rag_clean(F.col("text")))
    whole = F.array(F.struct(F.lit("").alias("content"), *[F.lit(0).alias(c) for c in ("tokens", "start_char", "end_char")]))
    # A lambda over one value cuts a text once, not again for the question whether it has chunks.
    some = F.element_at(F.transform(F.array(cut), lambda c: F.when(F.size(c) > 0, c).otherwise(whole)), 1)
    rows = documents.select("doc_id", "lang", F.sha2("text", 256).alias("content_hash"), F.posexplode(some).alias("chunk_index", "c"))
    return rows.select(
        "doc_id", "lang", "content_hash", "chunk_index", F.col("c.content").alias("content"), F.col("c.tokens").alias("tokens"),
        search_normal(F.col("c.content")).alias("search_content"),
    )


def first_contents(documents: DataFrame, known_for: str = "7 days") -> DataFrame:
    """Content hashes, each once however often its text comes within a time of ingestion, after which it is forgotten."""
    seen = documents.select(F.sha2("text", 256).alias("content_hash"), F.current_timestamp().alias("seen_at"))
    return seen.withWatermark("seen_at", known_for).dropDuplicatesWithinWatermark(["content_hash"]).select("content_hash")


def rate_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls per user and tumbling window, for the ``update`` mode: a window's count so far, final once it can't change."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    return counted.select("user_id", F.col("w.start").alias("start"), "calls")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Activity sessions per user, events closer than the gap, for the ``append`` mode: those that are closed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), "n")


#: How an event moves a status.
MOVES = {("pending", "view"): "processing", ("processing", "purchase"): "completed", ("processing", "error"): "failed", ("failed", "click"): "pending"}


def statuses(events: DataFrame, idle_days: int = 30) -> DataFrame:
    """(user_id, status, events): a status per key, moved by events in their order; idle keys are forgotten.

    The timeout goes by the watermark: one by the clock would keep an ``availableNow`` run going without end. A task holds
    the order, kind and time of one key's events of one batch; the size of a batch is the source's setting.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, n = state.get if state.exists else ("pending", 0)
        rows = pd.concat(list(batches)).sort_values("event_id")  # the events of one key in one micro-batch
        for kind in rows.event_type:
            status, n = MOVES.get((status, kind), status), n + 1
        state.update((status, n))
        last = int(rows.ts.max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_days * 86_400_000)
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "events": [n]})

    timed = events.select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 day")
    return timed.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, status string, events long", "status string, events long", "update", GroupStateTimeout.EventTimeTimeout
    )
