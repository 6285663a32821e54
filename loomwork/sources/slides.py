"""Slides from their shapes: texts, tables and groups of any depth in reading order, pictures with their numbers.

Shapes are rows: deck, slide, shape_id, parent_id (the group a shape is in, null for none), seq (its place in the file), kind
(text, table, group, picture), top, left, paragraphs, cells and media_type. A shape's place is that of the groups above it
and its own, so groups are opened level by level until no shape is left, and one sort puts all in order.

Defined results: null places are 0; shapes at one place stay in the order of the file; blank paragraphs, empty cells and what has no
text are left out; a shape whose group is not there is in none of the slides; an empty table of shapes gives no slide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import staged

SHAPES = (
    "deck long, slide int, shape_id long, parent_id long, seq int, kind string, top double, left double, "
    "paragraphs array<struct<text:string,level:int,bullet:boolean>>, cells array<array<string>>, media_type string"
)
#: Shapes this close in height are read from left to right.
BAND = 10
DEEPEST = 50


def _place() -> Column:
    zero = F.lit(0.0)
    return F.struct(
        F.floor(F.coalesce("top", zero) / BAND).cast("double").alias("band"), F.coalesce("left", zero).cast("double").alias("left"), F.col("seq").alias("seq"), F.col("shape_id").alias("id")
    )


def shape_text() -> Column:
    """Text of a shape: paragraphs as lines, bulleted ones indented; a table's rows with their headings."""

    def line(p: Column) -> Column:
        return F.when(p["bullet"], F.concat(F.repeat(F.lit("  "), F.coalesce(p["level"], F.lit(0))), F.lit("- "), p["text"])).otherwise(p["text"])

    heads = F.get("cells", F.lit(0))

    def cell(c: Column, i: Column) -> Column:
        head = F.coalesce(F.get(heads, i), F.lit(""))
        said = F.when(F.trim(head) != "", F.concat(head, F.lit(": "), c)).otherwise(c)
        return F.when(F.trim(c) != "", said)

    rows = F.transform(F.slice("cells", 2, 1 << 20), lambda r: F.array_join(F.array_compact(F.transform(r, cell)), "; "))
    lines = F.transform(F.filter("paragraphs", lambda p: F.trim(p["text"]) != ""), line)
    return F.when(F.col("kind") == "table", F.array_join(F.filter(rows, lambda r: r != ""), "\n")).when(F.col("kind") == "text", F.array_join(lines, "\n"))


def in_order(shapes: DataFrame) -> DataFrame:
    """Shapes of slides and of the groups on them, with ``path``: their places from the slide down.

    Shapes are written once. Level by level only groups are joined, without what they say; then each shape meets its group once.
    """
    held = staged(shapes, "shapes")
    keys = ["deck", "slide", "parent_id"]
    groups = held.filter("kind = 'group'").select("deck", "slide", "shape_id", "parent_id", _place().alias("place"))
    named = lambda df, path: staged(df.select("deck", "slide", F.col("shape_id").alias("parent_id"), path.alias("above")), "groups")
    levels = [named(groups.filter("parent_id is null"), F.array("place"))]
    while not levels[-1].isEmpty():
        if len(levels) > DEEPEST:
            raise ValueError(f"groups are nested more than {DEEPEST} levels deep")
        levels.append(named(groups.filter("parent_id is not null").join(levels[-1], keys), F.array_append("above", F.col("place"))))
    inner = held.filter("parent_id is not null").join(reduce(DataFrame.unionByName, levels), keys).withColumn("path", F.array_append("above", _place()))
    roots = held.filter("parent_id is null").withColumn("path", F.array(_place()))
    return roots.unionByName(inner.select(roots.columns))


def slide_texts(shapes: DataFrame) -> DataFrame:
    """(deck, slide, content) of the slides that have shapes."""
    said = shapes.select("deck", "slide", "shape_id", "parent_id", "seq", "kind", "top", "left", F.nullif(shape_text(), F.lit("")).alias("text"))
    # Shapes on slides say which slides there are; inside groups only texts and further groups count.
    texts = in_order(said.filter("parent_id is null or kind = 'group' or text is not null"))
    listed = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("path", "text"))))
    return texts.groupBy("deck", "slide").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("content"))


def slide_pictures(shapes: DataFrame) -> DataFrame:
    """(deck, slide, shape_id, index, format, filename) of the pictures that lie on slides themselves, numbered through a deck."""
    kinds = F.coalesce("media_type", F.lit(""))
    form = F.when(kinds.rlike("jpeg|jpg"), "jpeg").when(kinds.contains("png"), "png").when(kinds.contains("gif"), "gif").when(kinds.contains("webp"), "webp").otherwise("png")
    found = shapes.filter("kind = 'picture' and parent_id is null")
    index = (F.row_number().over(Window.partitionBy("deck").orderBy("slide", "seq", "shape_id")) - 1).alias("index")
    found = found.select("deck", "slide", "shape_id", index, form.alias("format"))
    return found.withColumn("filename", F.format_string("slide_%d_image_%d.%s", "slide", "index", "format"))
