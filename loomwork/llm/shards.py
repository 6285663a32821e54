"""Sharding by rendezvous hashing: every shard bids for a record by its stable key, and the highest bid takes it.

A bid is ``weight / -ln(u)`` with u in (0, 1) from a digest of key and shard, so shards take records in proportion to their
weights. One more shard only adds its own bids: a record stays where it is or moves to the new shard, and a shard that gets a
larger weight only takes records. Placing a record needs nothing but its key, no table and no shuffle.

``write_shards`` writes a table into shard folders, each in the order of keys, with one shuffle: ranges of (shard, key),
in which rows of one key are told apart by their position in the input, so that a hot key or shard fills several ranges.
A row's slot in its shard is its place in the range plus the rows of the shard in earlier ranges, of which
there is one count for each shard and range; ``read_shards`` adds it.

Defined results: a null key is a key of its own, first in its shard; a null text has no bytes, so size 1, and the checksum
of none; repeated rows lie in one shard under slots of their own; an empty table gives an empty one; other columns
are written and read with the row, and those named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwork.llm._common import documents, free_names, new_folder, own_columns, shuffle_partitions, staged, text_or_empty

SHARDS = 8
#: Bits of a digest that make u; with the half that is added, u is exact in a double.
BITS = 52


def bids(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """Array of (bid, -shard), of which the greatest wins: of equal bids the lower shard's."""
    if not weights or min(weights) < 0:
        raise ValueError("a shard needs a weight of 0 or more")
    named = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))

    def bid(shard: int, weight: float) -> Column:
        drawn = F.conv(F.substring(F.md5(F.concat(named, F.lit(f"@{shard}"))), 1, BITS // 4), 16, 10).cast("long")
        u = (drawn.cast("double") + 0.5) / float(1 << BITS)
        return F.struct((F.lit(float(weight)) / -F.ln(u)).alias("bid"), F.lit(-shard).alias("shard"))

    return F.array(*[bid(first + i, w) for i, w in enumerate(weights)])


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key, 0 to len(weights) - 1."""
    return -F.array_max(bids(key, weights)).getField("shard")


def with_shards(df: DataFrame, key: str, weights: Sequence[float], new_weight: float | None = None) -> DataFrame:
    """``df`` with ``shard``, and with ``grown_shard``: the shard if there were one more, of this weight (None: null)."""
    kept = own_columns(df, "shard", "grown_shard")
    (offered,) = free_names(df, "bids")
    n = len(weights)
    all_bids = bids(F.col(key), [*weights, *([] if new_weight is None else [new_weight])])
    bidding = df.withColumn(offered, all_bids)
    shard = -F.array_max(F.slice(offered, 1, n)).getField("shard")
    grown = F.lit(None).cast("int") if new_weight is None else -F.array_max(F.col(offered)).getField("shard")
    return bidding.select(*kept, shard.alias("shard"), grown.alias("grown_shard"))


def write_shards(sharded: DataFrame, key: str, path: str, among: Sequence[str] = ()) -> None:
    """Write rows that have a ``shard`` into one folder per shard, in the order of ``key`` and ``among``, and where each
    range of a shard begins."""
    row, folder = free_names(sharded, "row", "folder")
    numbered = sharded.withColumn(row, F.monotonically_increasing_id()).withColumn(folder, F.col("shard"))
    order = [folder, F.col(key).asc_nulls_first(), *among, row]
    ranged = numbered.repartitionByRange(shuffle_partitions(sharded.sparkSession), *order).sortWithinPartitions(*order)
    placed = ranged.select(
        F.col(folder).alias("folder"),
        F.spark_partition_id().alias("range"),
        F.monotonically_increasing_id().alias("at"),
        F.struct(*sharded.columns).alias("record"),
    )
    placed.write.partitionBy("folder").option("compression", "zstd").parquet(f"{path}/rows")
    spark = sharded.sparkSession
    ranges = _rows(spark, path, sharded).groupBy("folder", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("folder").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    ranges.select("folder", "range", "first", before).write.parquet(f"{path}/ranges")


def _rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    schema = StructType().add("range", "integer").add("at", "long").add("record", like.schema).add("folder", "integer")
    return spark.read.schema(schema).parquet(f"{path}/rows")


def read_shards(spark: SparkSession, path: str, like: DataFrame, shards: Sequence[int] | None = None) -> DataFrame:
    """The written rows with their ``slot``, gapless from 0 in each shard; ``shards``: only these folders are read."""
    rows = _rows(spark, path, like)
    if shards is not None:
        rows = rows.filter(F.col("folder").isin(*shards))
    # As many rows as there are ranges and shards together, at most.
    ranges = spark.read.parquet(f"{path}/ranges")
    slot = (F.col("before") + F.col("at") - F.col("first")).alias("slot")
    kept = [F.col("record").getField(c).alias(c) for c in own_columns(like, "slot")]
    return rows.join(F.broadcast(ranges), ["folder", "range"]).select(*kept, slot)


def shard_rows(docs: DataFrame, key: str, weights: Sequence[float], new_weight: float | None = None, among: Sequence[str] = ()) -> DataFrame:
    """``docs`` in shards on the shared folder, read back with shard, grown_shard and slot."""
    sharded = with_shards(docs, key, weights, new_weight)
    path = new_folder(docs.sparkSession, "shards")
    write_shards(sharded, key, path, among)
    return read_shards(docs.sparkSession, path, sharded)


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty()
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))
    measured = staged(documents(spark, sf_dir).select("doc_id", size.alias("size"), crc.alias("text_crc32")), "shard-sizes")
    placed = shard_rows(measured, "doc_id", [1.0] * SHARDS, 1.0, among=["size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


OP13_SQL = """
WITH crc_table AS (
    SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)), i) ORDER BY i) AS t FROM range(256) AS r(i)),
hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
measured AS (
    SELECT doc_id, len(hx) // 2 + 1 AS size,
           xor(list_reduce(list_transform(range(0, len(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT),
                           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
    FROM hexed, crc_table),
bids AS (
    SELECT doc_id, s, 1.0::DOUBLE / -ln((('0x' || substr(md5(coalesce('k' || doc_id, 'n') || '@' || s), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS bid
    FROM documents, range(9) AS shards(s)),
placed AS (
    SELECT doc_id, arg_max(s, bid) FILTER (s < 8) AS shard, arg_max(s, bid) AS grown_shard FROM bids GROUP BY doc_id)
SELECT m.doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY m.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM measured m JOIN placed p ON p.doc_id IS NOT DISTINCT FROM m.doc_id
"""
