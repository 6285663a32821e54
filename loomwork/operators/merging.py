"""Merging lines under their headings, in two ways. Both work inside a document's row: its lines and levels are arrays there, and
nothing of a document is sorted, joined or shuffled again.

``hierarchical_merge``: each line of the lowest levels with the headings that stand above it, which are the last lines before
it of every higher level. Levels are gone through from the text upwards; a heading that a chunk already holds makes none
of its own.

``tree_merge``: headings down to a target level are the nodes of a tree and hold the lines that follow them; each leaf makes
a chunk of its own lines below those of the nodes above it.

Only levels, as numbers, go to the two folds in Python, which give places of lines back.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import patterns as P
from loomwork.functions.text import not_bullet, not_title, strip
from loomwork.operators.structure import bullet_set, first_of
from loomwork.session import staged

#: Any heading of a set, and of any set: most lines are none and need no look at the patterns one by one.
SET_HEADINGS = tuple(f"^(?:{P.any_of(s)})" for s in P.BULLET_SETS)
HEADING = P.any_of(SET_HEADINGS)
SIZES = tuple(len(s) for s in P.BULLET_SETS)


def _seen(line: Column) -> Column:
    """Whether merges see a line: not those that are empty, a single character or digits."""
    text = F.trim(F.substring_index(line, "@", 1))
    return (F.length(text) > 1) & ~text.rlike("^[0-9]+$")


def _titled(line: Column, layout: Column | None) -> Column:
    return F.lit(False) if layout is None else layout.rlike("title|head") & ~not_title(line)


def merge_levels(lines: DataFrame, key: str, layout: Column | None = None) -> DataFrame:
    """(key, line_no, line, bullet_set, size, level) of the lines that merges see: of documents with headings, without empty
    lines, single characters and lines of digits. A level is the index of the first pattern that matches, then that of
    titles by ``layout``, then that of text."""
    rows = lines.join(bullet_set(lines, key), key).filter((F.col("bullet_set") >= 0) & _seen(F.col("line")))
    level = F.lit(None).cast("int")
    for i, s in enumerate(P.BULLET_SETS):
        own = F.coalesce(first_of(F.col("line"), s), F.when(_titled(F.col("line"), layout), len(s)), F.lit(len(s) + 1))
        level = F.when(F.col("bullet_set") == i, own).otherwise(level)
    size = F.element_at(F.array(*map(F.lit, SIZES)), F.col("bullet_set") + 1)
    return staged(rows.select(key, "line_no", "line", "bullet_set", size.alias("size"), level.alias("level")), "levels")


def text_levels(docs: DataFrame, key: str, text: str = "text", layout: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, size, lines, levels) of texts: what ``merge_levels`` gives of their lines, a row a document, without a shuffle.
    Documents without headings have null levels. ``layout`` is a function of the line."""

    def looked(line: Column) -> Column:
        hits = F.when(line.rlike(HEADING), F.array(*[F.when(line.rlike(h), first_of(line, s)) for h, s in zip(SET_HEADINGS, P.BULLET_SETS, strict=True)]))
        title = _titled(line, None if layout is None else layout(line))
        return F.struct(line.alias("line"), hits.alias("hits"), title.alias("title"), _seen(line).alias("seen"))

    rows = docs.select(key, F.transform(F.transform(F.split(text, "\n"), strip), looked).alias("l"))
    real = F.filter("l", lambda x: x["hits"].isNotNull() & ~not_bullet(x["line"]))
    rows = rows.select(key, F.filter("l", lambda x: x["seen"]).alias("l"), F.transform(real, lambda x: x["hits"]).alias("real"))
    hit = lambda i: F.size(F.filter("real", lambda hits: hits[i].isNotNull()))
    rows = rows.select(key, "l", F.array(*[hit(i) for i in range(len(SIZES))]).alias("n"))
    first = (F.array_position("n", F.array_max("n")) - 1).cast("int")  # of equals the first
    rows = rows.select(key, "l", F.when(F.array_max("n") > 0, first).otherwise(-1).alias("s"))
    size = F.get(F.array(*map(F.lit, SIZES)), F.col("s"))
    rows = rows.select(key, "l", "s", F.when(F.col("s") >= 0, size).alias("size"))
    level = lambda x: F.coalesce(F.get(x["hits"], F.col("s")), F.when(x["title"], F.col("size")), F.col("size") + 1)
    return rows.select(key, "size", F.transform("l", lambda x: x["line"]).alias("lines"), F.when(F.col("s") >= 0, F.transform("l", level)).alias("levels"))


def gathered(levels: DataFrame, key: str) -> DataFrame:
    """A table of lines, as ``merge_levels`` gives it, in the form of ``text_levels``."""
    listed = F.array_sort(F.collect_list(F.struct("line_no", "line", "level")))
    rows = levels.groupBy(key).agg(listed.alias("l"), F.first("size").alias("size"))
    return rows.select(key, "size", F.transform("l", lambda x: x["line"]).alias("lines"), F.transform("l", lambda x: x["level"]).alias("levels"))


def _rows(levels: DataFrame, key: str) -> DataFrame:
    return levels if "levels" in levels.columns else gathered(levels, key)


def tree_places(depth: int, most: int | None) -> Callable:
    """(levels, size) to the chunks of a document by ``tree_merge``: level, node, parent, and the place and number of lines of its nodes."""

    def fold(levels: list[int], size: int) -> list[dict]:
        seen = sorted(set(levels))
        if not seen:
            return []
        wanted = seen[min(depth, len(seen)) - 1]
        target = seen[-2] if wanted == size + 1 and len(seen) > 1 else wanted
        heads = [i for i, x in enumerate(levels) if x <= target]
        made: list[dict] = []
        if heads[0]:
            made.append({"level": None, "node": 0, "parent": None, "spans": [{"first": 1, "n": heads[0]}]})
        above: list[tuple[int, int, dict]] = []
        for node, (i, after) in enumerate(zip(heads, [*heads[1:], len(levels)], strict=True), 1):
            if most is not None and len(made) >= most:
                break
            level = levels[i]
            # The latest node of a higher level heads this one unless a still higher one came after it.
            while above and above[-1][0] >= level:
                above.pop()
            parent = above[-1][1] if above else 0
            above.append((level, node, {"first": i + 1, "n": after - i}))
            if after == len(levels) or levels[after] <= level:
                made.append({"level": level, "node": node, "parent": parent, "spans": [a[2] for a in above]})
        return made

    return fold


def hierarchical_places(depth: int, most: int | None) -> Callable:
    """(levels, size) to the chunks of a document by ``hierarchical_merge``: the places of their lines, headings first."""

    def fold(levels: list[int], size: int) -> list[list[int]]:
        latest: dict[int, int] = {}
        own: list[list[list[int]]] = [[] for _ in range(depth)]
        for place, level in enumerate(levels):
            if 0 <= size + 1 - level < depth:
                chain = [place]
                # Headings of the second highest level stand alone.
                for x in [] if level == 1 else [latest[n] for n in range(level - 1, -1, -1) if n in latest]:
                    # A heading goes instead of the one below it where it stands behind that.
                    if x > chain[-1]:
                        chain.pop()
                    chain.append(x)
                own[size + 1 - level].append(chain)
            latest[level] = place
        made: list[list[int]] = []
        held: set[int] = set()
        for chains in own:
            new = [c for c in chains if c[0] not in held]
            held.update(place for c in new for place in c)
            made += new
        return [c[::-1] for c in (made if most is None else made[:most])]

    return fold


SPAN = pa.struct([("first", pa.int32()), ("n", pa.int32())])
TREE = pa.list_(pa.struct([("level", pa.int32()), ("node", pa.int64()), ("parent", pa.int64()), ("spans", pa.list_(SPAN))]))
TREE_SPARK = "array<struct<level:int,node:bigint,parent:bigint,spans:array<struct<first:int,n:int>>>>"


def _folded(fold: Callable, kind: pa.DataType, shown: str) -> Column:
    """``fold`` of each document's levels. Not marked as deterministic, so that no later step runs it a second time."""

    def run(levels: pa.Array, size: pa.Array) -> pa.Array:
        return pa.array([None if x is None else fold(x, n) for x, n in zip(levels.to_pylist(), size.to_pylist(), strict=True)], kind)

    return F.arrow_udf(run, shown).asNondeterministic()("levels", "size")


def tree_merge(levels: DataFrame, key: str, depth: int, most: int | None = None) -> DataFrame:
    """(key, at, level, node, parent, lines): chunks of ``levels`` (as of ``merge_levels`` or ``text_levels``) in the order of the
    text, ``most`` at most.

    The target level is the ``depth``-th of those that occur, or the last, but not that of text where there is another. A
    heading of the target level or above is a node under the last one before it of a higher level. Lines before the first
    node are a chunk alone (node 0); a node with nodes below it has no chunk but heads theirs.
    """
    found = _rows(levels, key).select(key, "lines", _folded(tree_places(depth, most), TREE, TREE_SPARK).alias("chunks"))
    text = lambda c: F.flatten(F.transform(c["spans"], lambda s: F.slice("lines", s["first"], s["n"])))
    shown = F.transform("chunks", lambda c: F.struct(c["level"].alias("level"), c["node"].alias("node"), c["parent"].alias("parent"), text(c).alias("lines")))
    return found.select(key, F.posexplode(shown).alias("at", "c")).select(key, "at", "c.level", "c.node", "c.parent", "c.lines")


def hierarchical_merge(levels: DataFrame, key: str, depth: int, most: int | None = None) -> DataFrame:
    """(key, at, lines): chunks of ``levels`` (as of ``merge_levels`` or ``text_levels``) in order of level and place, ``most`` at most."""
    kind = pa.list_(pa.list_(pa.int32()))
    found = _rows(levels, key).select(key, "lines", _folded(hierarchical_places(depth, most), kind, "array<array<int>>").alias("chunks"))
    shown = F.transform("chunks", lambda c: F.transform(c, lambda i: F.get("lines", i)))
    return found.select(key, F.posexplode(shown).alias("at", "lines"))
