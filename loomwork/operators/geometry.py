"""Boxes on pages: overlap, suppression of doubles, layout of text boxes, margins.

Boxes have x0, y0, x1, y1. Everything but suppression is column arithmetic after an equi-join on the page; suppression is
greedy by score, so the boxes of one page and class, a bounded handful, are folded in one group. Tables are built from Arrow
batches of whole tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomwork.session import staged

SIDES = ("x0", "y0", "x1", "y1")


def area(box: str = "") -> Column:
    """Area of the box whose columns start with ``box``; 0 for a box turned inside out."""
    width, height = F.col(f"{box}x1") - F.col(f"{box}x0"), F.col(f"{box}y1") - F.col(f"{box}y0")
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def overlap(a: str, b: str) -> Column:
    """Area that two boxes share."""
    width = F.least(f"{a}x1", f"{b}x1") - F.greatest(f"{a}x0", f"{b}x0")
    height = F.least(f"{a}y1", f"{b}y1") - F.greatest(f"{a}y0", f"{b}y0")
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def iou(a: str, b: str) -> Column:
    """Shared area over the area of both together."""
    return overlap(a, b) / (area(a) + area(b) - overlap(a, b) + F.lit(1e-6))


def clipped(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Boxes cut at the page."""
    most = {"x0": width, "x1": width, "y0": height, "y1": height}
    return boxes.withColumns({s: F.least(F.greatest(F.col(s), F.lit(0.0)), F.lit(float(most[s]))) for s in SIDES})


def suppressed(boxes: DataFrame, keys: list[str], id_col: str, threshold: float = 0.45) -> DataFrame:
    """(keys, id_col) of the boxes that stay: best score first, a box goes if it overlaps one that stays by more."""
    box = F.struct((-F.col("score")).alias("s"), F.col(id_col).alias("id"), *[F.col(s) for s in SIDES])
    listed = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("rows"))

    def size(x: Column) -> Column:
        return F.greatest(x["x1"] - x["x0"], F.lit(0.0)) * F.greatest(x["y1"] - x["y0"], F.lit(0.0))

    def covers(x: Column, y: Column) -> Column:
        width = F.greatest(F.least(x["x1"], y["x1"]) - F.greatest(x["x0"], y["x0"]), F.lit(0.0))
        height = F.greatest(F.least(x["y1"], y["y1"]) - F.greatest(x["y0"], y["y0"]), F.lit(0.0))
        return width * height / (size(x) + size(y) - width * height + F.lit(1e-6)) > threshold

    def put(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda y: covers(x, y)), kept).otherwise(F.array_append(kept, x))

    stay = F.aggregate("rows", F.filter("rows", lambda x: F.lit(False)), put)
    return listed.select(*keys, F.explode(F.transform(stay, lambda x: x["id"])).alias(id_col))


#: The classes of a layout model in order of their numbers, the size of its input, and what counts as found.
LAYOUTS = ("title", "text", "reference", "figure", "figure_caption", "table", "table_caption", "header", "footer", "equation")
INPUT_SIZE = (1024, 1024)
LEAST_SCORE = 0.2


def suppressed_by_cells(boxes: DataFrame, keys: list[str], id_col: str, threshold: float = 0.45, cell: float = 100.0) -> DataFrame:
    """What ``suppressed`` gives, without a fold over a page: for pages with very many boxes.

    Boxes that overlap share a cell of the page, so pairs come from an equi-join of cells. In rounds, a box stays once all
    better boxes that overlap it are gone, and goes once one of them stays; there are as many rounds as a chain of
    overlapping boxes, each better than the next, is long.
    """
    cells = [F.sequence(F.floor(F.col(a) / cell), F.floor(F.greatest(F.col(a), F.col(b)) / cell)) for a, b in (("x0", "x1"), ("y0", "y1"))]
    rows = staged(boxes.select(*keys, F.col(id_col).alias("id"), "score", *SIDES), "boxes")
    dealt = rows.withColumn("across", F.explode(cells[0])).withColumn("down", F.explode(cells[1]))
    place = [*keys, "across", "down"]
    side = lambda mark: dealt.select(*place, *[F.col(c).alias(f"{mark}{c}") for c in ("id", "score", *SIDES)])
    better = (F.col("a_score") > F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & (F.col("a_id") < F.col("b_id")))
    pairs = side("a_").join(side("b_"), place).filter(better).filter(iou("a_", "b_") > threshold)
    open_pairs = staged(pairs.select(*keys, "a_id", "b_id").distinct(), "box-pairs")
    open_boxes, stay = rows.select(*keys, "id"), []
    while not open_boxes.isEmpty():
        doubted = open_pairs.select(*keys, F.col("b_id").alias("id")).distinct()
        kept = staged(open_boxes.join(doubted, [*keys, "id"], "left_anti"), "boxes-kept")
        stay.append(kept)
        gone = open_pairs.join(kept.withColumnRenamed("id", "a_id"), [*keys, "a_id"], "left_semi").select(*keys, F.col("b_id").alias("id")).distinct()
        open_boxes = staged(open_boxes.join(kept, [*keys, "id"], "left_anti").join(gone, [*keys, "id"], "left_anti"), "boxes-open")
        left = open_boxes.withColumnRenamed("id", "a_id"), open_boxes.withColumnRenamed("id", "b_id")
        open_pairs = staged(open_pairs.join(left[0], [*keys, "a_id"], "left_semi").join(left[1], [*keys, "b_id"], "left_semi").select(*keys, "a_id", "b_id"), "box-pairs")
    every = reduce(DataFrame.unionByName, stay) if stay else rows.select(*keys, "id")
    return every.withColumnRenamed("id", id_col)


def suppressed_in_bands(boxes: DataFrame, keys: list[str], id_col: str, threshold: float = 0.45, cell: float = 100.0, band: int = 500) -> DataFrame:
    """The rows of ``boxes`` that ``suppressed`` lets stay, for pages with any number of boxes: no pair of boxes becomes a row.

    In rounds, the best ``band`` open boxes of each group are folded, twice as many in each next round. Those that stay go to the
    other open boxes of their group, as lists by the cells of the page that they touch, and close what they overlap. What
    stays hardly overlaps, so a group has no more of it than its page has room for, however many boxes there are.
    """

    def cells() -> Column:
        across, down = (F.sequence(F.floor(F.col(a) / cell), F.floor(F.greatest(F.col(a), F.col(b)) / cell)) for a, b in (("x0", "x1"), ("y0", "y1")))
        return F.flatten(F.transform(across, lambda a: F.transform(down, lambda d: F.struct(a.alias("a"), d.alias("d")))))

    def size(x: Column | None) -> Column:
        return area() if x is None else F.greatest(x["x1"] - x["x0"], F.lit(0.0)) * F.greatest(x["y1"] - x["y0"], F.lit(0.0))

    def covered(y: Column) -> Column:
        width = F.least(F.col("x1"), y["x1"]) - F.greatest(F.col("x0"), y["x0"])
        height = F.least(F.col("y1"), y["y1"]) - F.greatest(F.col("y0"), y["y0"])
        shared = F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))
        return shared / (size(None) + size(y) - shared + F.lit(1e-6)) > threshold

    place = F.struct((-F.col("score")).alias("s"), F.col(id_col).alias("i"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), id_col)
    open_boxes, stay = boxes, []
    while True:
        best = staged(open_boxes.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= band).drop("_n"), "boxes-best")
        if best.isEmpty():
            break
        kept = staged(best.join(suppressed(best, keys, id_col, threshold), [*keys, id_col], "left_semi").select(*boxes.columns), "boxes-kept")
        stay.append(kept)
        lists = kept.select(*keys, F.explode(cells()).alias("_c"), F.struct(*SIDES).alias("_b")).groupBy(*keys, "_c").agg(F.collect_list("_b").alias("_l"))
        held = lists.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_c", "_l"))).alias("_held"))
        last = best.groupBy(*keys).agg(F.max(place).alias("_last"))
        rest = open_boxes.join(held.join(last, keys), keys).filter(place > F.col("_last"))
        hit = F.exists(cells(), lambda c: F.coalesce(F.exists(F.try_element_at("_held", c), covered), F.lit(False)))
        open_boxes, band = staged(rest.filter(~hit).select(*boxes.columns), "boxes-open"), 2 * band
    return reduce(DataFrame.unionByName, stay) if stay else boxes


def layout_boxes(found: DataFrame, pages: DataFrame, page: str, id_col: str, least: float = LEAST_SCORE, size: tuple[int, int] = INPUT_SIZE) -> DataFrame:
    """(page, id, kind, score, box) on the pages themselves, from a model's detections (page, id, class, score, box) in its input.

    Pages (page, width, height) were scaled to fit the input and put in its middle; boxes go the way back. Detections below
    ``least`` and of unknown classes go, and of boxes of a class that cover each other the best stays.
    """
    scale = F.least(F.lit(size[0]) / F.col("height"), F.lit(size[1]) / F.col("width"))
    inner = {"x": F.floor(F.col("width") * scale), "y": F.floor(F.col("height") * scale)}
    ways = pages.select(
        page,
        *[((F.lit(most) - inner[d]) / 2).alias(f"{d}_pad") for d, most in (("x", size[1]), ("y", size[0]))],
        *[(F.col(whole) / inner[d]).alias(f"{d}_scale") for d, whole in (("x", "width"), ("y", "height"))],
    )
    placed = found.filter(F.col("score") >= least).join(ways, page)
    placed = placed.withColumns({s: (F.col(s) - F.col(f"{s[0]}_pad")) * F.col(f"{s[0]}_scale") for s in SIDES})
    kind = F.get(F.array(*[F.lit(x) for x in LAYOUTS]), F.col("class"))
    placed = staged(placed.select(page, id_col, "class", "score", *SIDES, kind.alias("kind")), "layout")
    return suppressed_in_bands(placed, [page, "class"], id_col).filter("kind is not null").drop("class")


def assigned(texts: DataFrame, layouts: DataFrame, page: str, least: float = 0.4) -> DataFrame:
    """``texts`` (page, text_id, box) with the kind of the layout box that covers most of each, null below ``least``.

    The first of equal layouts (by layout_id) counts.
    """
    t = texts.select(page, "text_id", *[F.col(s).alias(f"t_{s}") for s in SIDES])
    b = layouts.select(page, "layout_id", "kind", *[F.col(s).alias(f"l_{s}") for s in SIDES])
    share = overlap("t_", "l_") / F.greatest(area("t_"), F.lit(1e-6))
    near = t.join(b, page).withColumn("share", share).filter(F.col("share") >= least)
    best = near.groupBy(page, "text_id").agg(F.max_by("kind", F.struct("share", -F.col("layout_id"))).alias("kind"))
    return t.select(page, "text_id").join(best, [page, "text_id"], "left")


def without_margins(boxes: DataFrame, height: float, share: float = 0.1) -> DataFrame:
    """Without headers that end in the top margin and footers that begin in the bottom one; other kinds stay."""
    top = (F.col("kind") == "header") & (F.col("y1") < height * share)
    bottom = (F.col("kind") == "footer") & (F.col("y0") > height * (1 - share))
    return boxes.filter(~(top | bottom))


def reading_order(boxes: DataFrame, page: str, id_col: str, threshold: float | Column, down: str = "top", across: str = "x0") -> DataFrame:
    """``boxes`` with row and place: rows of boxes less than ``threshold`` below their first one, each from left to right.

    A threshold of each page is an aggregate of its boxes. Boxes are in order of ``down``, so only the row begun last can take the next one: a fold over a page's boxes. With
    ``down`` and ``across`` exchanged they are columns, from top to bottom.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(down).cast("double").alias("d"), F.col(id_col).alias("i"), F.struct(*boxes.columns).alias("b"))))
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pages = boxes.groupBy(page).agg(listed.alias("l"), limit.alias("limit"))
    row = F.struct(F.col("l")[0]["b"].alias("b"), F.lit(0).alias("row"))
    start = F.struct(F.slice(F.array(row), 1, 0).alias("rows"), F.lit(-1).alias("row"), F.lit(None).cast("double").alias("first"))

    def put(s, x):
        new = F.coalesce(x["d"] - s["first"] >= F.col("limit"), F.lit(True))
        at = F.when(new, s["row"] + 1).otherwise(s["row"])
        return F.struct(
            F.array_append(s["rows"], F.struct(x["b"].alias("b"), at.alias("row"))).alias("rows"), at.alias("row"), F.when(new, x["d"]).otherwise(s["first"]).alias("first")
        )

    rows = pages.select(F.explode(F.aggregate("l", start, put, lambda s: s["rows"])).alias("r")).select("r.b.*", "r.row")
    order = Window.partitionBy(page).orderBy("row", across, down, id_col)
    return rows.withColumn("place", F.row_number().over(order) - 1)


def aligned(parts: DataFrame, table: str, kind: str = "kind") -> DataFrame:
    """Detected rows and columns of tables with their outer edges drawn out to the common ones.

    The common edges of more than four rows are their means, of more than four columns their medians; of fewer, the outermost.
    """
    own = Window.partitionBy(table, kind)
    is_row, many = F.col(kind).contains("row"), F.count(F.lit(1)).over(own) > 4

    def edge(c: str, middle: Column, outer: Column) -> Column:
        common = F.when(many, middle.over(own)).otherwise(outer.over(own))
        return F.least(c, common) if c in ("x0", "y0") else F.greatest(c, common)

    x0, x1 = edge("x0", F.avg("x0"), F.min("x0")), edge("x1", F.avg("x1"), F.max("x1"))
    y0, y1 = edge("y0", F.median("y0"), F.min("y0")), edge("y1", F.median("y1"), F.max("y1"))
    made = {"x0": F.when(is_row, x0).otherwise(F.col("x0")), "x1": F.when(is_row, x1).otherwise(F.col("x1"))}
    made |= {"y0": F.when(is_row, F.col("y0")).otherwise(y0), "y1": F.when(is_row, F.col("y1")).otherwise(y1)}
    return parts.select(*[made[c].alias(c) if c in made else F.col(c) for c in parts.columns])


#: How a caption begins.
CAPTIONS = (r"^[Tt]able\s*[0-9]+", r"^[Ff]ig(?:ure)?\s*[0-9]+")
#: A row ends this much above the edge that its cells have on average.
ROW_SLACK = 3.0


def is_caption(text: Column, layout: Column) -> Column:
    """Whether a box is a table's caption, by its text or by its kind."""
    named = F.coalesce(F.trim(text).rlike(CAPTIONS[0]) | F.trim(text).rlike(CAPTIONS[1]), F.lit(False))
    return named | F.coalesce(F.contains(F.lower(layout), F.lit("caption")), F.lit(False))


def _sorted(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` of tables k in partitions of whole tables, in ``order``; ``first`` says where a table begins."""
    place = F.row_number().over(Window.partitionBy("k").orderBy(*order))
    return rows.withColumn("first", place == 1).sortWithinPartitions("k", *order)


def _by_tables(work: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """``work`` on batches of whole tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch["first"].to_numpy(zero_copy_only=False))
            if len(starts):
                held.append(batch.slice(0, starts[-1]))
                if sum(b.num_rows for b in held):
                    yield work(pa.concat_batches(held))
                held = []
            held.append(batch.slice(starts[-1] if len(starts) else 0))
        if sum(b.num_rows for b in held):
            yield work(pa.concat_batches(held))

    return run


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, NaN for null, and where they are null."""
    return column.to_numpy(zero_copy_only=False).astype(float), column.is_null().to_numpy(zero_copy_only=False)


def _folded(starts: np.ndarray, sizes: np.ndarray, begins: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Row of each box: the fold goes over all tables at once, box by box; ``begins`` gets the places of the n-th boxes of the
    tables that have so many, largest tables first, and says which begin a row."""
    by_size = np.argsort(-sizes, kind="stable")
    counts = np.searchsorted(-sizes[by_size], -np.arange(sizes.max()), side="left")
    row, out = np.full(len(starts), -1, dtype=np.int32), np.empty(sizes.sum(), dtype=np.int32)
    for n, k in enumerate(counts):
        at = starts[by_size[:k]] + n
        row[:k] += begins(at, k)
        out[at] = row[:k]
    return out


@np.errstate(invalid="ignore")  # inf - inf
def _celled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Boxes of whole tables, in order of y0, as cells in order. Comparisons are Spark's: NaN is above all, null begins a row."""
    first = batch["first"].to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(first)
    sizes, table = np.diff([*starts, len(first)]), np.cumsum(first)
    (x0, no_x0), (y0, no_y0), (y1, no_y1) = (_numbers(batch[c]) for c in ("x0", "y0", "y1"))
    height = y1 - y0
    limit = np.fmin.reduceat(height, starts) / 2
    numbers = np.logical_or.reduceat(~(no_y0 | no_y1), starts)
    limit = np.repeat(np.where(numbers, limit, -np.inf), sizes)
    top = np.full(len(starts), np.nan)

    def read(at: np.ndarray, k: int) -> np.ndarray:
        below = y0[at] - top[:k]
        new = np.isnan(below) | (below >= limit[at])
        top[:k] = np.where(new, y0[at], top[:k])
        return new

    across = (np.nan_to_num(x0, nan=0.0, posinf=np.inf, neginf=-np.inf), np.where(no_x0, 0, np.where(np.isnan(x0), 2, 1)))
    order = np.lexsort((*across, _folded(starts, sizes, read), table))
    y0, y1, no_y1 = y0[order], y1[order], no_y1[order]
    edge, no_edge = np.full(len(starts), np.nan), np.ones(len(starts), dtype=bool)

    def lower(at: np.ndarray, k: int) -> np.ndarray:
        new = no_edge[:k] | np.isnan(y0[at]) | (y0[at] >= edge[:k] - ROW_SLACK)
        edge[:k] = np.where(new, y1[at], (edge[:k] + y1[at]) / 2)
        no_edge[:k] = no_y1[at]
        return new

    row = _folded(starts, sizes, lower)
    again = np.lexsort((*(a[order] for a in across), row, table))
    order, row = order[again], row[again]
    begins = np.flatnonzero(first | np.r_[True, row[1:] != row[:-1]])
    col = np.arange(len(row)) - np.repeat(begins, np.diff([*begins, len(row)]))
    kept = batch.select(["k", "id", "text", "colspan", "rowspan"]).take(pa.array(order))
    return pa.RecordBatch.from_pydict(
        {"k": kept["k"], "row": pa.array(row, pa.int32()), "col": pa.array(col, pa.int32()), **{c: kept[c] for c in kept.schema.names[1:]}, "first": batch["first"]}
    )


def _texted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Cells of whole tables, in order, as texts."""
    first, row, text = batch["first"].to_numpy(zero_copy_only=False), batch["row"].cast(pa.int64()), batch["text"]
    known = pc.fill_null(row, -(2**63)).to_numpy(zero_copy_only=False)
    begins = first | np.r_[True, known[1:] != known[:-1]]
    ends = np.r_[begins[1:], True]

    def chosen(where: np.ndarray | pa.Array, then: str | pa.Array, other: str | pa.Array) -> pa.Array:
        return pc.if_else(where if isinstance(where, pa.Array) else pa.array(where), then, other)

    def joined(*parts: str | pa.Array) -> pa.Array:
        return pc.binary_join_element_wise(*parts, "")

    def span(name: str) -> pa.Array:
        return chosen(pc.fill_null(pc.greater(batch[name], 1), False), pc.fill_null(joined(f' {name}="', batch[name].cast(pa.string()), '"'), ""), "")

    def of_tables(parts: pa.Array) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array([*np.flatnonzero(first), len(first)], pa.int32()), parts), "")

    tag = chosen(pa.array(known == 0), "th", "td")
    cell = pc.fill_null(joined("    <", tag, span("colspan"), span("rowspan"), ">", text, "</", tag, ">\n"), "")
    html = of_tables(joined(chosen(begins, "  <tr>\n", ""), cell, chosen(ends, "  </tr>\n", "")))
    before = chosen(first, "", chosen(begins, "\n", chosen(text.is_valid(), " | ", "")))
    plain = of_tables(joined(before, pc.fill_null(text, "")))
    keys = batch["k"].take(pa.array(np.flatnonzero(first)))
    return pa.RecordBatch.from_pydict({"k": keys, "html": joined("<table>\n", html, "</table>"), "plain": plain})


def _as(schema: StructType, *steps: Callable[[pa.RecordBatch], pa.RecordBatch]):
    arrow = to_arrow_schema(schema)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = reduce(lambda b, step: step(b), steps, batch)
        return pa.RecordBatch.from_arrays([done[f.name].cast(f.type) for f in arrow], schema=arrow)

    return _by_tables(work)


def _boxes(boxes: DataFrame, table: str, id_col: str) -> DataFrame:
    spans = [F.coalesce(F.col(c), F.lit(1)).cast("int").alias(c) for c in ("colspan", "rowspan")]
    kept = boxes.filter(~is_caption(F.col("text"), F.col("layout")))
    sides = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "y1")]
    return _sorted(kept.select(F.col(table).alias("k"), F.col(id_col).alias("id"), *sides, F.trim(F.coalesce("text", F.lit(""))).alias("text"), *spans), "y0", "id")


def table_cells(boxes: DataFrame, table: str, id_col: str) -> DataFrame:
    """(table, row, col, id, text, colspan, rowspan) of the cells of tables, from boxes (x0, y0, x1, y1, text, layout, colspan, rowspan).

    Captions are left out. Cells are read in rows of half the least height; one that begins below the mean lower edge of the
    open row begins the next row. In a row, cells go from left to right. Missing spans are 1.
    """
    rows = _boxes(boxes, table, id_col)
    schema = StructType([rows.schema["k"]]).add("row", "integer").add("col", "integer").add(rows.schema["id"])
    schema = schema.add("text", "string").add("colspan", "integer").add("rowspan", "integer")
    found = rows.mapInArrow(_as(schema, _celled), schema)
    return found.select(F.col("k").alias(table), "row", "col", F.col("id").alias(id_col), "text", "colspan", "rowspan")


def _texts(rows: DataFrame, table: str, *steps: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    schema = StructType([rows.schema["k"]]).add("html", "string").add("plain", "string")
    return rows.mapInArrow(_as(schema, *steps), schema).select(F.col("k").alias(table), "html", "plain")


def table_texts(cells: DataFrame, table: str) -> DataFrame:
    """(table, html, plain): tables as HTML, the first row as headings, and as lines of cells between bars."""
    rows = cells.select(F.col(table).alias("k"), "row", F.isnull("text").alias("none"), "col", "text", "colspan", "rowspan")
    return _texts(_sorted(rows, "row", "none", "col"), table, _texted)


def built_tables(boxes: DataFrame, table: str, id_col: str) -> DataFrame:
    """``table_texts`` of the ``table_cells`` of boxes, which are shuffled and sorted once for both."""
    return _texts(_boxes(boxes, table, id_col), table, _celled, _texted)
