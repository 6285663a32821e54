"""Token ids as binary shards with a minimal perfect hash index.

Documents are dealt by ranges of doc_id, sorted, encoded, and written as shards of a bounded size. A shard is one row of
a Parquet table in a folder for each range, alone in its row group and not compressed, so any store Spark reaches will do:
its ``blob`` holds raw ids, 2 or 4 bytes each, behind an index from document key to record. The index is a minimal perfect
hash: a key's bucket gives a displacement, and the displaced hash is the key's slot among exactly as many slots as there
are keys. The slot stores a fingerprint, which tells most foreign keys from stored ones, and the record.

A keyed read takes the folder by the ranges' first and last keys, the row group by the shard's, and the record by the
index: it reads one shard, and costs the same however many documents there are. Only a key with so many copies that they
fill more than a shard lies in several. The keys themselves stand in a column of their own, for readers of everything;
keyed reads leave it out.

Blob layout, little-endian: magic, keys, buckets, records, width (4 x u32); displacements (u32 a bucket); fingerprints,
first records, copies (u32 a key each); offsets in ids (u64 a record, and one more); ids.

Defined results: null or empty text is the end id alone; a very long text is a shard of its own; repeated doc_ids are
neighbouring records under one key, in as many ranges and shards as they need (rows that are equal in doc_id and text in
one range); a null doc_id sorts first under a reserved key; an empty table gives no shard; extra columns don't matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm._common import bytes_read, documents, new_folder, range_of, shuffle_partitions, staged, text_or_empty, tokenizer_path
from loomwork.llm.tokens import WORD_BPE, encoder

END_ID = 1
MAGIC = b"LWIDS001"
HEAD = struct.Struct("<8s4I")
SHARD_BYTES = 1 << 19
RANGE_BYTES = 128 << 20
SHARD_DOCS = 4096
KEYS_PER_BUCKET = 4
NULL_KEY = -(1 << 63)
SHARDS = "part int, number int, n_ids long, first_key long, last_key long, keys binary, blob binary"
#: Keys that are looked up in a shard at a time.
KEYS_AT_ONCE = 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _slots(hashes: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        moved = hashes + (displacement.astype(np.uint64) + np.uint64(1)) * np.uint64(0x632BE59BD9B4E019)
    return (_mixed(moved) % np.uint64(n)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacement per bucket, and the slot of each of the different ``keys``."""
    n = len(keys)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    hashes = _mixed(keys.view(np.uint64))
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    ends = np.cumsum(sizes)
    displacement, slots, free = np.zeros(buckets, np.uint32), np.empty(n, np.int64), np.ones(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        own = order[ends[b] - sizes[b] : ends[b]]
        at, tries = 0, 64
        while True:
            tried = np.arange(at, at + tries)
            places = _slots(hashes[own][None, :], tried[:, None], n)
            fits = free[places].all(1)
            if len(own) > 1:
                ordered = np.sort(places, 1)
                fits &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
            if fits.any():
                k = int(fits.argmax())
                break
            at, tries = at + tries, min(2 * tries, 1 << 14)
        displacement[b] = at + k
        slots[own] = places[k]
        free[places[k]] = False
    return displacement, slots


def write_shard(keys: list[int], records: list[bytes], width: int) -> tuple[bytes, bytes]:
    """(different keys, blob) of records in ascending order of their keys; equal keys are neighbours."""
    all_keys = np.array(keys, np.int64)
    distinct, first, copies = np.unique(all_keys, return_index=True, return_counts=True)
    displacement, slots = build_index(distinct)
    prints, firsts, counts = (np.zeros(len(distinct), "<u4") for _ in range(3))
    prints[slots] = (_mixed(distinct.view(np.uint64)) >> np.uint64(32)).astype("<u4")
    firsts[slots], counts[slots] = first, copies
    offsets = np.zeros(len(records) + 1, "<u8")
    offsets[1:] = np.cumsum([len(r) // width for r in records])
    head = HEAD.pack(MAGIC, len(distinct), len(displacement), len(records), width)
    parts = [head, displacement.astype("<u4"), prints, firsts, counts, offsets]
    return distinct.astype("<i8").tobytes(), b"".join([*(bytes(p) for p in parts), *records])


class Shard:
    """Keyed reads from a blob."""

    def __init__(self, blob: bytes):
        magic, self.n, buckets, records, self.width = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(blob, kind, n, at)
            at += found.nbytes
            return found

        self.displacement = part("<u4", buckets)
        self.prints, self.firsts, self.copies = (part("<u4", self.n) for _ in range(3))
        self.offsets, self.blob, self.ids_at = part("<u8", records + 1), blob, at

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the stored fingerprint is another one's."""
        hashes = _mixed(keys.view(np.uint64))
        bucket = (hashes % np.uint64(len(self.displacement))).astype(np.int64)
        slots = _slots(hashes, self.displacement[bucket], self.n)
        return np.where(self.prints[slots] == (hashes >> np.uint64(32)).astype("<u4"), slots, -1)

    def records(self, slot: int) -> Iterator[tuple[int, np.ndarray]]:
        """(ids before it in the shard, ids) of each record under a key."""
        for r in range(int(self.firsts[slot]), int(self.firsts[slot]) + int(self.copies[slot])):
            a, b = int(self.offsets[r]), int(self.offsets[r + 1])
            yield a, np.frombuffer(self.blob, f"<u{self.width}", b - a, self.ids_at + a * self.width)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, width: int = 2) -> None:
    """Encode all of ``docs`` and write the shards, in ascending doc_id order, to the table at ``path``."""
    end = np.array([end_id], f"<u{width}").tobytes()

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own, part, number = encoder(tokenizer, width), TaskContext.get().partitionId(), 0
        keys: list[int] = []
        records: list[bytes] = []
        held = 0

        def row() -> pd.DataFrame:
            index, blob = write_shard(keys, records, width)
            bounds = {"first_key": [keys[0]], "last_key": [keys[-1]], "keys": [index], "blob": [blob]}
            return pd.DataFrame({"part": [part], "number": [number], "n_ids": [held // width]} | bounds)

        for b in batches:
            for key, ids in zip(b.key.tolist(), own.encode(b.text), strict=True):
                if records and (held + len(ids) > SHARD_BYTES or len(records) >= SHARD_DOCS):
                    yield row()
                    keys, records, held, number = [], [], 0, number + 1
                keys.append(key)
                records.append(ids + end)
                held += len(ids) + len(end)
        if records:
            yield row()

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key")
    ordered = docs.select(key, text_or_empty().alias("text")).withColumn("among", F.xxhash64("text"))
    # Ranges of about RANGE_BYTES of what is read, and as many as the session sets for its shuffles at least. Copies of one
    # key are told apart by their text, so that a key with very many rows may fill several ranges.
    ranges = max(shuffle_partitions(docs.sparkSession), bytes_read(docs) // RANGE_BYTES)
    ordered = ordered.repartitionByRange(ranges, "key", "among")
    ordered = ordered.sortWithinPartitions("key", "among", "text").select("key", "text")
    # One shard a row group, as it is: readers find it by its first and last key.
    options = {"compression": "uncompressed", "parquet.block.row.count.limit": "1", "parquet.page.size.row.check.min": "1"}
    ordered.mapInPandas(shards, SHARDS).write.partitionBy("part").options(**options).parquet(path)


def _starts(table: DataFrame) -> DataFrame:
    """(part, number, base): ids before each shard. Ranges first, then the shards within a range."""
    ids = table.select("part", "number", "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ids.groupBy("part").agg(F.sum("n_ids").alias("ids")).select(
        "part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("range_base")
    )
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    shards = ids.select("part", "number", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("in_range"))
    return shards.join(ranges, "part").select("part", "number", (F.col("range_base") + F.col("in_range")).alias("base"))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for x in b.itertuples(index=False):
            shard, keys = Shard(x.blob), np.frombuffer(x.keys, "<i8")
            rows = []
            for key, slot in zip(keys.tolist(), shard.find(keys).tolist(), strict=True):
                if slot >= 0:
                    for at, ids in shard.records(slot):
                        rows.append((key, x.part, x.number, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            yield pd.DataFrame(rows, columns=["key", "part", "number", "at", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, each read through its shard's index."""
    table = _table(spark, path)
    starts = staged(_starts(table), "token-starts")
    read = table.mapInPandas(_read, "key long, part int, number int, at long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "number"]).select(
        F.nullif("key", F.lit(NULL_KEY)).alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def _ranges(table: DataFrame) -> list:
    """(part, first, last) of each range that has rows, in order: as many rows as there are ranges, not documents."""
    ends = table.groupBy("part").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last"))
    return sorted(ends.collect(), key=lambda r: r.part)


def _ids(blob: bytes, wanted: np.ndarray) -> list[tuple[int, np.ndarray]]:
    shard = Shard(blob)
    slots = shard.find(wanted)
    return [
        (key, ids.astype(np.int32))
        for key, slot in zip(wanted[slots >= 0].tolist(), slots[slots >= 0].tolist(), strict=True)
        for _, ids in shard.records(slot)
    ]


def fetch(spark: SparkSession, path: str, key: int) -> DataFrame:
    """(doc_id, ids) of one document: the folder of its range, there the row group of its shard, there its record."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for blob in b.blob for r in _ids(blob, np.array([key], np.int64))]
            yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    table = _table(spark, path)
    parts = [r.part for r in _ranges(table) if r["first"] <= key <= r["last"]]
    held = table.filter(F.col("part").isin(parts) & (F.col("first_key") <= key) & (F.col("last_key") >= key))
    return held.select("blob").mapInPandas(found, "doc_id long, ids array<int>")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents whose doc_id is in ``keys``: only folders and shards that may hold one are read.

    A key finds its ranges by halving among their first and last keys, and its shards by a join within a range.
    """

    def fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for x in b.itertuples(index=False) for r in _ids(x.blob, np.asarray(x.wanted, np.int64))]
            yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    table = _table(spark, path)
    ranges = _ranges(table)
    at = [F.lit(0), F.lit(-1)]
    if ranges:
        at = [range_of(F.col("doc_id") - 1, [r["last"] for r in ranges]), range_of(F.col("doc_id"), [r["first"] for r in ranges]) - 1]
    asked = keys.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    asked = asked.select("doc_id", at[0].alias("a"), at[1].alias("b")).filter("a <= b")
    parts = F.array(*[F.lit(r.part) for r in ranges]).cast("array<int>")
    asked = asked.select("doc_id", F.explode(F.sequence("a", "b")).alias("n")).select("doc_id", F.get(parts, F.col("n")).alias("part"))
    asked = staged(asked, "token-keys")
    some = [r.part for r in asked.select("part").distinct().collect()]  # ranges, not keys
    table = table.filter(F.col("part").isin(some))
    shards = table.select("part", "number", "first_key", "last_key")
    held = asked.join(shards, "part").filter("doc_id between first_key and last_key")
    order = Window.partitionBy("part", "number").orderBy("doc_id")
    held = held.withColumn("block", F.floor((F.row_number().over(order) - 1) / KEYS_AT_ONCE))
    wanted = held.groupBy("part", "number", "block").agg(F.collect_list("doc_id").alias("wanted"))
    found = table.select("part", "number", "blob").join(wanted, ["part", "number"]).select("blob", "wanted")
    return found.mapInPandas(fetched, "doc_id long, ids array<int>")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path, tokenizer_path(WORD_BPE))
    return read_token_files(spark, path)
