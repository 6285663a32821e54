"""Prefix trie of conversations: shared beginnings as nodes of a table, with what they save.

A node is a distinct beginning of d turns. Its id is 128 bits: the turns' digests, each hashed with its position, joined by
exclusive or. So ids can be summed in any order and in parts, and a conversation of any length is spread over tasks:

1. Turns, as digests and word counts, are sorted into ranges by (conv_id, turn). The rows of one conversation in one range
   are a leg; numbers, running ids and running words are taken within legs, and a small table of legs carries them over.
2. Each task sums its own turns into a partial node table, a partial trie; the tables merge by node id (members, smallest
   member, words), and once more for children and parents.
3. The rollup goes from the ends up: what a conversation adds to every subtree it lies in is known once it is known which
   nodes it is the smallest member of, so one more merge gives leaves and saved tokens of every node, however deep.
4. Lists of conversations that end at a node are merged in blocks of neighbouring ids, then hashed block by block in order.

Saved tokens of node v with words w, words P up to and with v, and smallest member o: all its members have (sum of W) -
n (P - w) words below and at v, and the distinct nodes there have those of the members' own nodes (O, nodes of which a
member is the smallest; for o all that lie below v count). The difference is what is saved.

Defined results: a null turn comes first, equal turns by the digest of role and text; null role or text is empty; rows without a
conv_id belong to no conversation and are left out; repeated rows are turns of their own; a conversation whose turns were
all replaced by none is a member of the root; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm._common import shuffle_partitions, staged, text_or_empty
from loomwork.llm.mixing import word_count

#: A conversation takes its first turns from the conversation whose id is the next lower multiple of this.
FAMILY = 20
#: And so many of them at most, by the checksum of its id.
MOST_LENT = 3
#: Ends of a node are merged in blocks of 2^10 neighbouring ids.
BLOCK_BITS = 10
NODE = ["depth", "a", "b"]
LENT, ROOT = -1, -2


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words, row): what the trie needs of a turn, without its text."""
    role, text = text_or_empty("role"), text_or_empty()
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    own = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), word_count(text).alias("words")
    )
    return own.withColumn("row", F.monotonically_increasing_id())


def in_legs(turns: DataFrame) -> DataFrame:
    """(conv_id, leg, at, digest, words): turns in order; ``at`` counts up by one within a leg."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "row"]
    ranged = turns.repartitionByRange(shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    leg, at = F.spark_partition_id().alias("leg"), F.monotonically_increasing_id().alias("at")
    return ranged.select("conv_id", leg, at, "digest", "words")


def _bits(start: int) -> Column:
    keyed = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")))
    return F.conv(F.substring(keyed, start, 16), 16, -10).cast("long")


def _running(turns: DataFrame, *leg: str) -> DataFrame:
    """Turns (depth, digest, words) with their own id and the running id and words of their leg."""
    upto = Window.partitionBy(*leg).orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = turns.withColumn("x", _bits(1)).withColumn("y", _bits(17)).drop("digest")
    ids = {f"{c}_upto": F.bit_xor(c).over(upto) for c in ("x", "y")}
    return own.withColumns(ids | {"words_upto": F.sum("words").over(upto)})


def rebuilt(legged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations with running sums of their legs, one row per conversation)."""
    legs = legged.groupBy("conv_id", "leg").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)
    legs = legs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    ids = legs.groupBy("conv_id").agg(F.sum("n").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    asked = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_LENT + 1)
    families = ids.select("conv_id", base.alias("base"), asked.alias("asked"))
    bases = ids.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    families = families.join(bases, "base", "left")
    lent = F.least("asked", F.coalesce("there", F.lit(0)))
    families = staged(families.select("conv_id", "base", "asked", lent.alias("lent")), "trie-families")
    legs = staged(legs.join(families, "conv_id").select("conv_id", "leg", "first", "before", "asked", "lent"), "trie-legs")
    placed = legged.join(legs, ["conv_id", "leg"]).withColumn("at", F.col("before") + F.col("at") - F.col("first"))
    own = placed.filter("at >= asked").select(
        "conv_id", "leg", (F.col("at") - F.col("asked") + F.col("lent") + 1).cast("long").alias("depth"), "digest", "words"
    )
    heads = placed.filter((F.col("conv_id") % FAMILY == 0) & (F.col("at") < MOST_LENT))
    heads = heads.select(F.col("conv_id").alias("base"), (F.col("at") + 1).cast("long").alias("depth"), "digest", "words")
    first = families.filter("lent > 0").join(_running(heads, "base"), "base").filter("depth <= lent").drop("base", "asked", "lent")
    own = _running(own, "conv_id", "leg")
    return staged(own.unionByName(first.withColumn("leg", F.lit(LENT))), "trie-turns"), families


def paths_of(turns: DataFrame, families: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per conversation and node on its way, one row per leg with its conversation's words)."""
    sums = turns.groupBy("conv_id", "leg").agg(
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("words").alias("words"), F.max("depth").alias("length")
    )
    earlier = Window.partitionBy("conv_id").orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    nothing = F.lit(0).cast("long")
    carried = staged(
        sums.select(
            "conv_id",
            "leg",
            F.coalesce(F.bit_xor("x").over(earlier), nothing).alias("x_before"),
            F.coalesce(F.bit_xor("y").over(earlier), nothing).alias("y_before"),
            F.coalesce(F.sum("words").over(earlier), nothing).alias("words_before"),
            F.sum("words").over(whole).alias("all_words"),
            F.max("length").over(whole).alias("length"),
        ),
        "trie-carried",
    )
    a, b = F.col("x_before").bitwiseXOR(F.col("x_upto")), F.col("y_before").bitwiseXOR(F.col("y_upto"))
    below = turns.join(carried, ["conv_id", "leg"]).select(
        "conv_id", "leg", "depth", a.alias("a"), b.alias("b"),
        a.bitwiseXOR(F.col("x")).alias("parent_a"), b.bitwiseXOR(F.col("y")).alias("parent_b"),
        "words", (F.col("words_before") + F.col("words_upto")).alias("upto"), (F.col("depth") == F.col("length")).alias("last"),
    )
    lengths = carried.groupBy("conv_id").agg(F.max("all_words").alias("all_words"), F.max("length").alias("length"))
    tops = families.select("conv_id").join(lengths, "conv_id", "left").select(
        "conv_id", F.coalesce("all_words", nothing).alias("all_words"), F.coalesce("length", nothing).alias("length")
    )
    tops = staged(tops.withColumn("leg", F.lit(ROOT)), "trie-roots")
    none = F.lit(None).cast("long")
    roots = tops.select(
        "conv_id", "leg", nothing.alias("depth"), nothing.alias("a"), nothing.alias("b"), none.alias("parent_a"),
        none.alias("parent_b"), nothing.alias("words"), nothing.alias("upto"), (F.col("length") == 0).alias("last"),
    )
    legs = carried.select("conv_id", "leg", "all_words").unionByName(tops.select("conv_id", "leg", "all_words"))
    return staged(below.unionByName(roots), "trie-paths"), legs


def nodes_of(paths: DataFrame) -> DataFrame:
    """The node table: members, smallest member, parent's id, words of the last text, children, parent's smallest member."""
    merged = paths.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("parent_a").alias("parent_a"),
        F.max("parent_b").alias("parent_b"), F.max("words").alias("words"), F.max("upto").alias("upto"),
    )
    merged = staged(merged, "trie-nodes")
    above = [(F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("a"), F.col("parent_b").alias("b")]
    children = merged.filter("depth > 0").select(*above).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    parents = merged.select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id")
    )
    found = merged.join(children, NODE, "left").join(parents, ["depth", "parent_a", "parent_b"], "left")
    return staged(found.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "trie-tree")


def rolled_up(paths: DataFrame, legs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, a, b, n_leaves, saved_tokens) of every node's subtree."""
    own = nodes.groupBy("conv_id").agg(F.sum("words").alias("own_words"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    nothing = F.lit(0).cast("long")
    adds = legs.join(own, "conv_id", "left").select(
        "conv_id", "leg", "all_words", F.coalesce("own_words", nothing).alias("own_words"), F.coalesce("leaves", nothing).alias("leaves")
    )
    summed = paths.join(adds, ["conv_id", "leg"]).groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n"), F.sum("all_words").alias("all_words"), F.sum("own_words").alias("own_words"),
        F.sum("leaves").alias("n_leaves"), F.min(F.struct("conv_id", "all_words", "own_words")).alias("o"),
        F.max(F.col("upto") - F.col("words")).alias("above"),
    )
    members = F.col("all_words") - F.col("n") * F.col("above")
    distinct = F.col("own_words") - F.col("o.own_words") + F.col("o.all_words") - F.col("above")
    return summed.select(*NODE, "n_leaves", (members - distinct).alias("saved_tokens"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of ids, sorted by node and block, to the digest of each node's whole list."""
    node, digest = None, hashlib.sha256()
    for batch in batches:
        done = []
        for *key, ids in batch[[*NODE, "ids"]].itertuples(index=False, name=None):
            if key == node:
                digest.update(f",{ids}".encode())
                continue
            if node is not None:
                done.append((*node, digest.hexdigest()))
            node, digest = key, hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=[*NODE, "ends_sha256"])


def end_digests(paths: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes at which conversations end."""
    block = F.shiftright("conv_id", BLOCK_BITS).alias("block")
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids")
    blocks = paths.filter("last").groupBy(*NODE, block).agg(ids)
    dealt = blocks.repartition(shuffle_partitions(paths.sparkSession), *NODE).sortWithinPartitions(*NODE, "block")
    return dealt.mapInPandas(_digests, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    legged = staged(in_legs(staged(turns_of(conversations), "trie-digests")), "trie-legged")
    turns, families = rebuilt(legged)
    paths, legs = paths_of(turns, families)
    nodes = nodes_of(paths)
    found = nodes.join(rolled_up(paths, legs, nodes), NODE).join(end_digests(paths), NODE, "left")
    ends = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256")
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


OP12_SQL = """
WITH ordered AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
    SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base,
           xor(list_reduce(
               list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
               lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, byte)),
               4294967295), 4294967295) % 4 AS h
    FROM ordered),
joined AS (
    SELECT i.conv_id, 0 AS own, o.pos, o.role, o.text FROM ids i JOIN ordered o ON o.conv_id = i.base AND o.pos <= i.h
    UNION ALL
    SELECT i.conv_id, 1, o.pos, o.role, o.text FROM ids i JOIN ordered o ON o.conv_id = i.conv_id AND o.pos > i.h),
turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, md5(role) || md5(text) AS digest,
           len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
    FROM joined),
chains AS (
    SELECT conv_id, depth, words, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS chain FROM turns),
paths AS (
    SELECT conv_id, depth, words, sha256(chain) AS node, coalesce(lag(sha256(chain)) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent,
           depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM chains
    UNION ALL
    SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM turns) FROM ids),
nodes AS (
    SELECT node, parent, depth, count(*) AS n_convs, min(conv_id) AS conv_id, any_value(words) AS words,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM paths GROUP BY node, parent, depth),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
subtrees AS (
    SELECT above.node, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens
    FROM nodes n LEFT JOIN kids k ON k.node = n.node JOIN paths above ON above.conv_id = n.conv_id AND above.depth <= n.depth
    GROUP BY above.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens,
       n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids k ON k.node = n.node JOIN subtrees s ON s.node = n.node
"""
