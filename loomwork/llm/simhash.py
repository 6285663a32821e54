"""SimHash near-duplicates by multi-index hashing.

Fingerprints (64 bits over 4-word shingles, XXH64 with seed 42) are computed in Arrow batches. Documents with the same
fingerprint are one node, so copies never meet each other in a join. Two fingerprints that differ in at most 4 bits
differ in at most one bit in one of three segments (21, 21 and 22 bits): each fingerprint is a home row in the table of
each segment, and visits the keys that differ from its own by setting one zero bit; a pair that differs in one bit of a
segment meets exactly once that way, at the home of the one that has the bit. The join keeps only verified pairs, and
only those that connect what isn't connected yet: before it, fingerprints that follow each other in a segment's table are
linked where they are close enough, so that a large group of near copies doesn't emit all of its pairs.

Tables of 21 bits hold few fingerprints a key as long as there are not many more fingerprints than keys. Above
``THREE_SEGMENTS`` of them the tables are those of the two halves, 32 bits each, of which one differs in two bits at most:
there a fingerprint's homes are its half and those one bit away, it visits the same keys, and pairs meet half-way. Both
ways find every link; a key's rows stay few in both. Keys that are dense all the same are split: Spark splits the join's,
and those with more than ``DENSE`` rows are put in order in parts.

Links become groups by passing smallest labels along links and jumping along pointers, with a table written each round.

Defined results: null or empty text has fingerprint zero and is linked like any other; texts of fewer than four words
have one shingle, the whole sequence; repeated rows share a fingerprint; an empty table gives an empty one; extra columns
don't matter, since only doc_id and text are read, and pass through ``one_of_each_group`` whatever they are called; very
long texts are hashed in parts; a null doc_id is never the smallest unless its group has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm._common import documents, free_names, staged

SHINGLE_WORDS = 4
MAX_BITS = 4
#: (first bit, bits) of the segments; with three segments and four differing bits one segment differs in one bit at most.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Halves, of which one differs in two bits at most.
HALVES = ((0, 32), (32, 32))
#: Fingerprints up to which three segments are used.
THREE_SEGMENTS = 1 << 24
#: Rows of a key that are put in order together.
DENSE = 4096
HASH_ROWS = 1 << 16


def fingerprint_of(text: str | None) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE_WORDS:
        hashes = [digest(b" ".join(words), 42)]
    else:
        hashes = [digest(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASH_ROWS):
        part = np.array(hashes[i : i + HASH_ROWS], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint_of(x) for x in batch], dtype="int64")


def _segment(fp: Column, start: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << bits) - 1))


def _visited(segment: int, key: Column, bits: int) -> Column:
    """The key itself and the keys with one more bit set: the half of the Hamming ball that meets each pair once."""
    ball = F.array_distinct(F.array(key, *[key.bitwiseOR(F.lit(1 << j)) for j in range(bits)]))
    return F.transform(ball, lambda k: F.struct(F.lit(segment).alias("segment"), k.alias("key")))


def _homes(nodes: DataFrame) -> DataFrame:
    """A row (segment, key, fp, node) for each fingerprint and segment."""
    homes = [
        F.struct(F.lit(s).alias("segment"), _segment(F.col("fp"), start, bits).alias("key"))
        for s, (start, bits) in enumerate(SEGMENTS)
    ]
    return nodes.select("fp", "node", F.explode(F.array(*homes)).alias("at")).select("at.*", "fp", "node")


def neighbour_links(nodes: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """Some of the links: those between fingerprints that follow each other in a key of a segment's table.

    There are as many at most as rows, and they join most of what a dense group holds. A key with more than ``dense`` rows
    is dealt into parts, each in order by itself.
    """
    homes = _homes(nodes)
    parts = homes.groupBy("segment", "key").agg(F.ceil(F.count(F.lit(1)) / dense).cast("long").alias("parts"))
    dealt = homes.join(parts.filter("parts > 1"), ["segment", "key"], "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))))
    in_order = Window.partitionBy("segment", "key", "part").orderBy("fp")
    pairs = dealt.select(
        F.col("node").alias("a"),
        F.lag("node").over(in_order).alias("b"),
        F.bit_count(F.col("fp").bitwiseXOR(F.lag("fp").over(in_order))).alias("bits"),
    )
    return pairs.filter(F.col("bits") <= max_bits).select("a", "b")


def _close(max_bits: int) -> Column:
    return (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= max_bits) & (F.col("a") != F.col("b"))


def _links_by_segments(nodes: DataFrame, max_bits: int) -> DataFrame:
    home = _homes(nodes).select("segment", "key", F.col("fp").alias("fp_b"), F.col("node").alias("b"))
    visits = [_visited(s, _segment(F.col("fp"), start, bits), bits) for s, (start, bits) in enumerate(SEGMENTS)]
    visit = nodes.select(F.col("fp").alias("fp_a"), F.col("node").alias("a"), F.explode(F.concat(*visits)).alias("at"))
    visit = visit.select("fp_a", "a", "at.*")
    # Pairs in one key meet twice (each visits its own home); keep one of the two.
    same = F.lit(False)
    for s, (start, bits) in enumerate(SEGMENTS):
        same = same | (
            (F.col("segment") == s) & (_segment(F.col("fp_a"), start, bits) == _segment(F.col("fp_b"), start, bits))
        )
    return visit.join(home, ["segment", "key"]).filter(_close(max_bits) & (~same | (F.col("a") < F.col("b"))))


def _links_by_halves(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Each fingerprint at its halves and at those one bit away; ``flip`` is the bit, -1 for the half itself.

    Equal halves meet where neither is flipped, halves one bit apart at the home of one, and halves two bits apart at the
    key where the one flips the lower of the two bits and the other the higher one.
    """
    def keys_of(segment: int, start: int, bits: int) -> Column:
        masks = F.array(*[F.lit(m).cast("long") for m in (0, *(1 << j for j in range(bits)))])
        half = _segment(F.col("fp"), start, bits)

        def key(mask: Column, i: Column) -> Column:
            return F.struct(F.lit(segment).alias("segment"), half.bitwiseXOR(mask).alias("key"), (i - 1).alias("flip"))

        return F.transform(masks, key)

    keys = [keys_of(s, start, bits) for s, (start, bits) in enumerate(HALVES)]
    at = nodes.select("fp", "node", F.explode(F.concat(*keys)).alias("at")).select("at.*", "fp", "node")
    one = at.select("segment", "key", F.col("flip").alias("flip_a"), F.col("fp").alias("fp_a"), F.col("node").alias("a"))
    other = at.select("segment", "key", F.col("flip").alias("flip_b"), F.col("fp").alias("fp_b"), F.col("node").alias("b"))
    half = F.when(F.col("segment") == 0, F.lit((1 << 32) - 1)).otherwise(F.lit(-(1 << 32)))
    apart = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b")).bitwiseAND(half))
    once = (
        ((apart == 0) & (F.col("flip_a") < 0) & (F.col("flip_b") < 0) & (F.col("a") < F.col("b")))
        | ((apart == 1) & (F.col("flip_a") >= 0) & (F.col("flip_b") < 0) & (F.col("a") < F.col("b")))
        | ((apart == 2) & (F.col("flip_a") >= 0) & (F.col("flip_a") < F.col("flip_b")) & (F.col("a") < F.col("b")))
    )
    return one.join(other, ["segment", "key"]).filter(_close(max_bits) & once)


def near_links(nodes: DataFrame, max_bits: int = MAX_BITS, halves: bool = False) -> DataFrame:
    """All links (a, b) between fingerprints ``fp`` in ``nodes`` that differ in at most ``max_bits`` bits and whose
    ``node`` differs. A link carries the nodes; one may come from more than one segment.

    Give fingerprints that are known to be connected the same node: pairs of one node go inside the join.
    """
    found = _links_by_halves(nodes, max_bits) if halves else _links_by_segments(nodes, max_bits)
    return found.select("a", "b")


def components(links: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours and then the label of that label, so chains
    shorten by half or more; every round is a written table.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = staged(both, f"{name}-links")
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), f"{name}-0")
    for n in range(1, max_rounds):
        spread = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("theirs")), "b")
        best = spread.groupBy("a").agg(F.min("theirs").alias("theirs"))
        moved = labels.join(best, "a", "left").select(
            "a", F.col("label").alias("before"), F.least("label", "theirs").alias("label")
        )
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("further"))
        after = moved.join(jump, "label", "left").select(
            "a", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("before")).alias("new")
        )
        after = staged(after, f"{name}-{n}")
        changed = after.filter("new").limit(1).count()
        labels = after.select("a", "label")
        if not changed:
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, text_hash, component_id) per row of ``docs``: the group each document belongs to."""
    text = F.col("text").cast("string")
    text_hash = F.xxhash64(F.coalesce(text, F.lit("")))
    marked = docs.select("doc_id", fingerprints(text).alias("fp"), text_hash.alias("text_hash"))
    marked = staged(marked, "simhash")
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    known = nodes.filter("node is not null")
    first = components(neighbour_links(known, max_bits), "simhash-first")
    joined = nodes.join(first, "node", "left").select("fp", F.coalesce("component", "node").alias("node"))
    joined = staged(joined, "simhash-joined")
    known = joined.filter("node is not null")
    groups = components(near_links(known, max_bits, known.count() > THREE_SEGMENTS), "simhash-groups")
    owner = joined.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(owner, "fp").select("doc_id", "fp", "text_hash", "component_id")


def one_of_each_group(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest doc_id.

    Of several rows with that doc_id the one with the smallest text hash stays; rows without a doc_id form groups of
    their own by fingerprint where no row of the group has one.
    """
    least = near_duplicates(docs, max_bits).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    of_no_id = F.when(F.col("doc_id").isNull(), F.col("fp")).alias("fp")
    rows = least.groupBy("doc_id", of_no_id, "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    kept = rows.groupBy("doc_id", "fp").agg(F.min(F.struct("text_hash", "rows")).alias("kept"))
    own_id, own_hash, copies, text_hash = free_names(docs, "id", "hash", "rows", "text_hash")
    kept = kept.select(
        F.col("doc_id").alias(own_id), F.col("kept.text_hash").alias(own_hash), F.col("kept.rows").alias(copies)
    )
    digest = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    whole = docs.withColumn(text_hash, digest).join(
        kept, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(text_hash) == F.col(own_hash))
    )
    once = whole.filter(F.col(copies) == 1).select(*docs.columns)
    again = whole.filter(F.col(copies) > 1).dropDuplicates(["doc_id", text_hash]).select(*docs.columns)
    return once.unionByName(again)


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
