"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch holds every hash of a text's five-word shingles that lies below a fixed fraction of the hash range, sorted. Its
size follows the text, so a part of a long document keeps its share of the long one's sketch, and containment can be
estimated between very unequal documents; the union of two sketches is the sketch of both texts. A text whose shingles
all miss the fraction keeps its smallest hash (unsigned) instead, so that only texts without words have an empty sketch;
``merged`` drops such a stand-in where regular hashes are present, and keeps the smaller of two.

``with_next`` pairs each document with the next one in descending order of doc_id without a global sort in one task:
cut points from a mergeable quantile summary, in which a document counts by its size, deal the ids into ranges of about
equally many bytes, a window pairs rows within a range, and the last row of a range is joined to the first of the next
range that has rows. A hot id fills several ranges, in the order of a hash of the text.

Defined results: null text is empty; an empty text has the empty sketch; two empty sketches are alike 1.0, an empty and
another one 0.0; fewer than five words make one shingle; a null doc_id comes last, repeated ids in descending order of
a hash of their text; a single row is its own next; a very long text has a long sketch; an empty table gives an empty one; other
columns pass through, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm._common import documents, free_names, range_of, shuffle_partitions, staged, text_or_empty

SHINGLE_WORDS = 5
#: A hash is kept if its first bits are all zero: 2 bits keep a quarter. A parameter of ``with_sketch`` and ``merged``.
KEEP_BITS = 2
WHITE = r"[\x20\x09-\x0D]+"
SMALLEST = -(1 << 63)
#: Bytes of a text that weigh as much as a row does, where rows are dealt into ranges.
ROW_BYTES = 2048


def _regular(hashes: Column, keep_bits: int) -> Column:
    return F.filter(hashes, lambda h: (h >= 0) & (h <= (1 << (64 - keep_bits)) - 1))


def _least(hashes: Column) -> Column:
    """The least hash in unsigned order: negative longs are the upper half of the range."""
    return F.coalesce(F.array_min(F.filter(hashes, lambda h: h >= 0)), F.array_min(hashes))


def with_sketch(df: DataFrame, text: Column, name: str, keep_bits: int = KEEP_BITS) -> DataFrame:
    """``df`` with the sketch of ``text`` as an array of longs. Steps are columns of their own, so each is computed once.

    ``keep_bits`` from 1 to 63 keep a share of 2^-keep_bits of the hashes. A resemblance j estimated from texts of n different
    shingles together has a standard error of about sqrt(j (1 - j) 2^keep_bits / n): with a quarter kept and 1,000 shingles
    at most 0.032, with 1/64 kept 0.127.
    """
    words, hashes = free_names(df, f"{name}_words", f"{name}_hashes")
    df = df.withColumn(words, F.array_remove(F.split(text, WHITE), ""))
    n = F.size(words) - (SHINGLE_WORDS - 1)
    # Shingles as rows of five shifted arrays: no function looks back into the text for each shingle.
    shifted = F.arrays_zip(*[F.slice(words, i + 1, n).alias(str(i)) for i in range(SHINGLE_WORDS)])
    many = F.transform(shifted, lambda s: F.xxhash64(*[s[str(i)] for i in range(SHINGLE_WORDS)]))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(
        hashes,
        F.when(n > 0, many)
        .when(F.size(words) > 0, F.array(F.xxhash64(F.concat_ws(" ", words))))
        .otherwise(none),
    )
    if not 1 <= keep_bits <= 63:
        raise ValueError("keep_bits is a number from 1 to 63")
    df = df.withColumn(name, F.sort_array(F.array_distinct(_regular(F.col(hashes), keep_bits))))
    stand_in = F.when((F.size(name) == 0) & (F.size(hashes) > 0), F.array(_least(F.col(hashes)))).otherwise(F.col(name))
    return df.withColumn(name, stand_in).drop(words, hashes)


def merged(a: Column, b: Column, keep_bits: int = KEEP_BITS) -> Column:
    """The sketch of two texts together: regular hashes of both, or else the least stand-in in unsigned order."""
    both = F.sort_array(F.array_union(a, b))
    regular = _regular(both, keep_bits)
    return F.when(F.size(regular) > 0, regular).when(F.size(both) > 0, F.array(_least(both))).otherwise(both)


def _ratio(part: Column, whole: Column, a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of both."""
    common = F.size(F.array_intersect(a, b))
    return _ratio(common, F.size(a) + F.size(b) - common, a, b)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller text's shingles that the larger one has."""
    return _ratio(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)), a, b)


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``docs`` (doc_id, text and more) with ``next_<c>`` for each of ``carried``: that of the next lower doc_id, round."""
    spark = docs.sparkSession
    key, place, among, after, head, top, follower = free_names(docs, "key", "range", "among", "next", "head", "top", "follower")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST))).withColumn(among, F.xxhash64("text"))
    ranges = 2 * shuffle_partitions(spark)
    # As many cut points as ranges reach the driver, whatever the size of the table.
    weight = (1 + F.coalesce(F.octet_length("text"), F.lit(0)) / ROW_BYTES).cast("int")
    weighed = keyed.select(F.explode(F.array_repeat(key, weight)).alias(key))
    found = weighed.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    cuts = sorted(found or [0])
    # A key that is several cut points fills as many ranges, dealt by a hash of the text.
    upto = range_of(F.col(key), cuts)
    below = F.when(F.col(key) > SMALLEST, range_of(F.col(key) - F.when(F.col(key) > SMALLEST, 1).otherwise(0), cuts)).otherwise(0)
    share = F.col(among) / F.lit(2.0**64) + 0.5
    own = F.when(upto > below, F.least(upto, below + 1 + F.floor(share * (upto - below)))).otherwise(upto).cast("int")
    ranged = keyed.withColumn(place, own)
    tops = staged(ranged.groupBy(place).agg(F.max(key).alias(top)), "next-tops")
    down = Window.orderBy(F.desc(place))
    follows = tops.select(F.col(place).alias(follower), F.coalesce(F.lead(place).over(down), F.max(place).over(Window.partitionBy())).alias(place))
    # One row for each range: the cut points bound this table.
    first = ranged.join(F.broadcast(tops.withColumnRenamed(top, key)), [place, key])
    best = F.max_by(F.struct(*carried), F.struct(among, "text"))
    heads = first.groupBy(place).agg(best.alias(head)).join(follows, place)
    heads = staged(heads.select(F.col(follower).alias(place), head), "next-heads")
    order = Window.partitionBy(place).orderBy(F.desc(key), F.desc(among), F.desc("text"))
    led = ranged.withColumn(after, F.lead(F.struct(*carried)).over(order))
    joined = led.join(heads, place, "left")
    pick = [F.coalesce(F.col(after), F.col(head)).getField(c).alias(f"next_{c}") for c in carried]
    return joined.select(*docs.columns, *pick)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", text_or_empty().alias("text"))
    paired = with_next(with_sketch(docs, F.col("text"), "sketch"), ["text", "sketch"])
    n, swapped = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - swapped), F.substr("next_text", F.lit(1), swapped))
    edited_rows = paired.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    both = with_sketch(edited_rows, F.col("edited"), "edited_sketch")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"),
    )
