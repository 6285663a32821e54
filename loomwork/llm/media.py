"""Media columns: payloads stored as FLAC streams, and their PCM blocks with sample offsets.

``encode_media`` writes streams, ``decode_media`` reads them, verifies every frame's and the whole stream's checksum and
gives a row of PCM blocks a stream, each block with the offset of its first sample; ``samples`` reads any stretch of
samples from the blocks that hold it. Both map Arrow batches without a shuffle; a task holds some thousands of frames at a
time besides its batch. A stream that fails a checksum gives no block and says why, it doesn't end the job.

Defined results: null or empty text is 64 zero bytes; equal texts give equal streams; repeated rows are stored each; a
very long text is a long stream; an empty table gives an empty one; extra columns don't matter, since only doc_id and text
are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import flac
from loomwork.llm._common import documents, staged, text_or_empty

MEDIA = "doc_id long, n_bytes long, media binary"
PCM = (
    "doc_id long, n_bytes long, media_bytes long, media_sha256 string, "
    "blocks array<struct<sample_offset:long,n_samples:int,pcm:binary>>, error string"
)
DIGESTS = (
    "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, "
    "tail_crc32 long, feature string, error string"
)
#: How PCM blocks are stored: large pages, so that texts share their words, and a harder search for them.
PCM_FILES = {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}
#: Bytes of an Arrow batch's rows that are coded and handed on together: frames of many rows in one step, in bounded memory.
GROUP_BYTES = 4 << 20


def _groups(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about GROUP_BYTES."""
    first, held, n = 0, 0, 0
    for size in sizes:
        held, n = held + size, n + 1
        if held >= GROUP_BYTES:
            yield first, n
            first, held = n, 0
    if n > first:
        yield first, n


def payload_of(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes(max(flac.ALIGN, -(-len(data) // flac.ALIGN) * flac.ALIGN) - len(data))


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text, padded with zero bytes to a multiple of 64, as a FLAC stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, end in _groups(b.n_bytes.tolist()):
                part = b.iloc[first:end]
                media = list(flac.encode(payload_of(t) for t in part.text))
                yield pd.DataFrame({"doc_id": part.doc_id, "n_bytes": part.n_bytes, "media": media})

    text = text_or_empty().alias("text")
    rows = docs.select(F.col("doc_id").cast("long"), text).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInPandas(run, MEDIA)


def decode_media(media: DataFrame) -> DataFrame:
    """A row of PCM blocks for each stream, with the stream's size and digest: a reader finds any sample by its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, end in _groups(len(x.as_buffer()) for x in whole.column("media")):
                b = whole.slice(first, end - first)
                streams = b.column("media").to_pylist()
                ends, offsets, blocks, wrong = [0], [], [], []
                for own, places, error in flac.decode(streams):
                    blocks += own
                    offsets += places
                    ends.append(len(blocks))
                    wrong.append(error)
                inner = pa.StructArray.from_arrays(
                    [pa.array(offsets, pa.int64()), pa.array([len(x) for x in blocks], pa.int32()), pa.array(blocks, pa.binary())],
                    ["sample_offset", "n_samples", "pcm"],
                )
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)
                sizes = pa.array([len(x) for x in streams], pa.int64())
                digests = pa.array([hashlib.sha256(x).hexdigest() for x in streams], pa.string())
                columns = [b.column("doc_id"), b.column("n_bytes"), sizes, digests, listed, pa.array(wrong, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PCM.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, PCM)


def samples(pcm: DataFrame, start: int | Column, n: int | Column) -> Column:
    """Samples ``start`` .. ``start + n - 1`` of each row's stream, from the blocks that hold any of them."""
    start, n = (F.lit(x) if isinstance(x, int) else x for x in (start, n))
    held = F.filter(
        pcm["blocks"], lambda b: (b["sample_offset"] < start + n) & (b["sample_offset"] + b["n_samples"] > start)
    )
    joined = F.aggregate(F.transform(held, lambda b: b["pcm"]), F.lit(b""), lambda s, x: F.concat(s, x))
    skipped = start - F.coalesce(F.get(held, F.lit(0))["sample_offset"], F.lit(0))
    return F.substring(joined, (skipped + 1).cast("int"), n.cast("int"))


def feature_of(pcm: bytes) -> str:
    """Length, mean square, turns of sign and largest step of the samples around the middle, all in whole numbers."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    step = np.abs(np.diff(x))
    turns = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"n={len(x)};energy={int((x * x).sum()) // len(x)};turns={turns};step={int(step.max())};steps={int(step.sum())}"


def payload_digests(pcm: DataFrame) -> DataFrame:
    """Digests and features of the samples in a table of PCM blocks, put together by their offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b.column("blocks").offsets.to_pylist()
            inner = b.column("blocks").values
            offsets, blocks = inner.field("sample_offset").to_pylist(), inner.field("pcm")
            rows: list[tuple] = []
            for first, end, wrong in zip(ends[:-1], ends[1:], b.column("error").to_pylist(), strict=True):
                order = sorted(range(first, end), key=offsets.__getitem__)
                data = b"".join(blocks[i].as_py() for i in order)
                if wrong is None and [offsets[i] for i in order] != list(range(0, len(data), flac.BLOCK)):
                    wrong = "blocks are missing"
                if wrong is None:
                    read = (hashlib.sha256(data).hexdigest(), zlib.crc32(data[-flac.ALIGN :]), feature_of(data))
                rows.append((len(data), *read, None) if wrong is None else (None, None, None, None, wrong))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            found = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            kept = [b.column(c) for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, *found], [c.split()[0] for c in DIGESTS.split(", ")])

    return pcm.mapInArrow(run, DIGESTS)


def op2_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams go from the encoder to the decoder in one stage; their PCM blocks with offsets are written and read back."""
    media = encode_media(documents(spark, sf_dir))
    return payload_digests(staged(decode_media(media), "pcm", **PCM_FILES)).drop("error")
