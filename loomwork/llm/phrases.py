"""Phrase collocations per language: frequent word sequences whose parts seldom go apart.

1. Spark cuts texts into pieces and sums identical ones: a piece is read once, with its multiplicity as its weight.
2. Each task turns pieces into n-grams of up to three words, sums those of a few megabytes of pieces, deals them into hash
   buckets of (lang, phrase) and sends a bucket's share as one compressed Arrow batch.
3. A task counts one bucket at a time in DuckDB, which groups the stream of batches within a fixed memory limit and
   spills beyond it (scratch files of the running task only). A phrase rarer than the threshold can be neither a candidate nor a part of one, nor
   cover one, so only frequent phrases leave the bucket.
4. Candidates send requests for their parts through a shuffle to where the parts' counts are; answers meet by candidate.

No list of words or phrases reaches the driver or is broadcast. Counts are 64-bit; products and their quotient are
decimals of 38 digits, exact for counts up to 10^15.

Defined results: null text has no pieces; a null lang is ``und`` (with rows that say so); pieces without words don't count;
repeated rows count each; very long texts and pieces are cut like others; ties rank by count, then by bytes of the
phrase; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm._common import documents, shuffle_partitions, staged, text_or_empty

LONGEST = 3
MIN_COUNT = 10
#: A longer candidate that makes up this share of a shorter one's count, in percent, stands for it.
COVER_PERCENT = 50
TOP = 2000
PARTS = 16
#: Bytes of pieces whose n-grams a task sums at a time, and bytes of different pieces for each bucket.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
#: A task sends a batch to each bucket, so buckets stop to grow in number here; then each counts more, out of core.
MOST_BUCKETS = 1 << 15
DUCKDB_MEMORY = "400MB"

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GRAMS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def pieces_of(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): different pieces, words joined by one space, and how often each occurs."""
    text = F.translate(text_or_empty(), CAPITALS + "\t", CAPITALS.lower() + " ")
    text = F.trim(F.regexp_replace(text, " {2,}", " "))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    cut = docs.select(lang, F.explode(F.split(text, r" ?[.,;:!?\x0A-\x0D] ?")).alias("piece"))
    return cut.filter("piece != ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("m"))


def word_totals(pieces: DataFrame) -> DataFrame:
    """(lang, n): all word occurrences."""
    words = F.length("piece") - F.length(F.translate("piece", " ", "")) + 1
    return pieces.groupBy("lang").agg(F.sum(F.col("m") * words).alias("n"))


def _grams(lang: pa.Array, piece: pa.Array, m: np.ndarray, buckets: int) -> tuple[np.ndarray, pa.RecordBatch]:
    """The different n-grams of some pieces with their weights, in order of their buckets."""
    import xxhash

    lists = pc.split_pattern(piece, " ")
    lengths = np.diff(lists.offsets.to_numpy())
    words = lists.flatten().dictionary_encode()
    langs = lang.dictionary_encode()
    of_piece = np.repeat(np.arange(len(lengths)), lengths)
    # A word of a language is one number.
    pairs = langs.indices.to_numpy()[of_piece].astype(np.int64) * len(words.dictionary) + words.indices.to_numpy()
    known, ids = np.unique(pairs, return_inverse=True)
    texts = words.dictionary.take(pa.array(known % len(words.dictionary)))
    own_lang = langs.dictionary.take(pa.array(known // len(words.dictionary)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in texts.to_pylist()), np.uint64, len(texts))
    weight, rest = m[of_piece], np.repeat(np.cumsum(lengths), lengths) - np.arange(len(ids))
    found: list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]] = []
    numbers = np.zeros(len(ids), np.int64)
    for n in range(1, LONGEST + 1):
        starts = np.flatnonzero(rest >= n)
        if not len(starts):
            break
        # The number of the phrase one word shorter, and the last word.
        key = numbers[starts] * len(known) + ids[starts + n - 1]
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        new = np.r_[True, in_order[1:] != in_order[:-1]]
        numbers[starts[order]] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        at = starts[order[first]]
        mixed = np.full(len(at), n, np.uint64)
        for i in range(n):
            mixed = (mixed ^ hashes[ids[at + i]]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        parts = [texts.take(pa.array(ids[at + i])) for i in range(n)]
        phrase = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
        bucket = ((mixed >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)
        found.append((own_lang.take(pa.array(ids[at])), phrase, np.add.reduceat(weight[starts][order], first), bucket))
    bucket = np.concatenate([x[3] for x in found])
    order = np.argsort(bucket, kind="stable")
    columns = [pa.concat_arrays([x[0] for x in found]), pa.concat_arrays([x[1] for x in found])]
    columns = [c.take(pa.array(order)) for c in columns]
    columns.append(pa.array(np.concatenate([x[2] for x in found])[order]))
    return bucket[order], pa.RecordBatch.from_arrays(columns, schema=GRAMS)


def _shares(buckets: int):
    """Pieces to (bucket, grams): a bucket's n-grams of a chunk as one compressed record batch."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        chunk = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        lang, piece = (chunk[c].cast(pa.string()) for c in ("lang", "piece"))
        bucket, grams = _grams(lang, piece, chunk["m"].to_numpy(), buckets)
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        blobs, options = [], pa.ipc.IpcWriteOptions(compression="zstd")
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, GRAMS, options=options) as stream:
                stream.write_batch(grams.slice(a, b - a))
            blobs.append(out.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array(blobs, pa.binary())], ["bucket", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size >= CHUNK_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return run


def _counted(min_count: int):
    """(bucket, grams), sorted by bucket, to (lang, phrase, f) of what a bucket holds at least ``min_count`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        shares = ((bucket, blob) for b in batches for bucket, blob in zip(b["bucket"].to_pylist(), b["grams"], strict=True))
        with tempfile.TemporaryDirectory() as scratch:
            con = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": scratch})
            con.execute("SET preserve_insertion_order = false")
            for _, own in groupby(shares, key=lambda x: x[0]):
                opened = (batch for _, blob in own for batch in pa.ipc.open_stream(blob.as_buffer()))
                stream = pa.RecordBatchReader.from_batches(GRAMS, opened)
                con.register("grams", stream)
                counted = con.sql(f"SELECT lang, phrase, sum(f)::BIGINT AS f FROM grams GROUP BY ALL HAVING sum(f) >= {int(min_count)}")
                yield from counted.to_arrow_reader(100_000)
                con.unregister("grams")
            con.close()

    return run


def frequent_phrases(pieces: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, f): all sequences of up to three words that occur at least ``min_count`` times."""
    least = shuffle_partitions(pieces.sparkSession)
    size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    buckets = min(max(least, size // BUCKET_BYTES), max(least, MOST_BUCKETS))
    dealt = pieces.mapInArrow(_shares(buckets), "bucket int, grams binary")
    dealt = dealt.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(_counted(min_count), "lang string, phrase string, f long")


def _part(start: int, length: Column | int) -> Column:
    return F.array_join(F.slice("words", start, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, words, a, l, r, score): each asks for the counts of the parts of each cut."""
    asking = counts.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words")).filter("size(words) > 1")
    cuts = [
        F.when(F.size("words") > k, F.array(*[
            F.struct(F.lit(k).alias("k"), F.lit(first).alias("first"), part.alias("part"))
            for first, part in ((True, _part(1, k)), (False, _part(k + 1, F.size("words") - k)))
        ]))
        for k in range(1, LONGEST)
    ]
    wanted = F.explode(F.flatten(F.filter(F.array(*cuts), lambda c: c.isNotNull()))).alias("cut")
    requests = asking.select("lang", "phrase", "a", wanted).select("lang", "phrase", "a", "cut.*")
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    sides = answers.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r")
    )
    a, most = F.col("a").cast("decimal(15,0)"), F.lit(1_000_000).cast("decimal(7,0)")
    sides = sides.withColumn("up", a * a * most).withColumn("down", F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(18,0)"))
    sides = sides.withColumn("score", F.expr("up div down"))
    lowest = sides.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covers(counts: DataFrame) -> DataFrame:
    """(lang, phrase, cover): the count of the most frequent candidate that a phrase of two words or more lies inside."""
    long = counts.select("lang", "f", F.split("phrase", " ").alias("words")).filter(F.size("words") > 2)
    inside = F.explode(F.array(_part(1, F.size("words") - 1), _part(2, F.size("words") - 1))).alias("phrase")
    return long.select("lang", inside, "f").groupBy("lang", "phrase").agg(F.max("f").alias("cover"))


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, cover_percent: int = COVER_PERCENT, top: int | None = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score); ``top`` None: all candidates that no longer one covers."""
    pieces = staged(pieces_of(docs), "phrase-pieces")
    counts = staged(frequent_phrases(pieces, min_count), "phrase-counts")
    kept = scored(counts).join(covers(counts), ["lang", "phrase"], "left")
    kept = kept.filter(F.col("cover").isNull() | (100 * F.col("cover") < cover_percent * F.col("a")))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:
        # The first of each part of a language's phrases, so that a language hands a task PARTS * top rows at most.
        kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
        kept = kept.withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("at") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(word_totals(pieces), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir).select("lang", "text"))


OP11_SQL = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws
    FROM (SELECT lang, unnest(regexp_split_to_array(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
grams AS (
    SELECT lang, unnest(list_transform(range(1, len(ws) - 0 + 1), lambda i: array_to_string(ws[i:i], ' '))) AS phrase, 1 AS w
    FROM pieces
    UNION ALL
    SELECT lang, unnest(list_transform(range(1, len(ws) - 1 + 1), lambda i: array_to_string(ws[i:i+1], ' '))), 2 FROM pieces
    UNION ALL
    SELECT lang, unnest(list_transform(range(1, len(ws) - 2 + 1), lambda i: array_to_string(ws[i:i+2], ' '))), 3 FROM pieces),
counts AS (SELECT lang, phrase, w, count(*) AS f, string_split(phrase, ' ') AS ws FROM grams GROUP BY lang, phrase, w HAVING count(*) >= 10),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
cuts AS (
    SELECT lang, phrase, f AS a, k, array_to_string(ws[1:k], ' ') AS p, array_to_string(ws[k+1:], ' ') AS q
    FROM counts, (VALUES (1), (2)) AS ks(k) WHERE k < w),
sides AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
           ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.p JOIN counts y ON y.lang = c.lang AND y.phrase = c.q),
lowest AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covered AS (
    SELECT lang, phrase, max(f) AS cover FROM (
        SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, f FROM counts WHERE w = 3
        UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), f FROM counts WHERE w = 3) GROUP BY lang, phrase),
kept AS (
    SELECT o.* FROM lowest o LEFT JOIN covered v ON v.lang = o.lang AND v.phrase = o.phrase
    WHERE v.cover IS NULL OR 100 * v.cover < 50 * o.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
