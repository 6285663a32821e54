"""Recursive chunking as column expressions: split where it hurts least, then pack pieces greedily up to a size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.text import token_estimate

SIZE = 512
#: Where a level splits; a delimiter stays with the piece before it.
DOCUMENT_LEVELS = (r"(?<=\n\n)(?!\n)", r"(?<=\n)", r"(?<=[.!?] )", r"(?<=[;,:] )", r"(?<=\s)(?=\S)")
CODE_LEVELS = (r"(?<=\n)(?=\n(?:class |def |async def ))", r"(?<=\n\n)", r"(?<=\n)", r"(?<=[;:] )", r"(?<=\s)(?=\S)")
#: Characters of a piece that no level splits.
HARD = 2000


def _split(text: Column, levels: tuple[str, ...], size: int) -> Column:
    """Pieces of a text: whole where it fits, else split at this level and each part at the next ones."""
    if not levels:
        n = F.ceil(F.length(text) / HARD).cast("int")
        cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * HARD + 1, F.lit(HARD)))
        return F.when(n <= 1, F.array(text)).otherwise(cut)
    parts = F.flatten(F.transform(F.split(text, levels[0]), lambda p: _split(p, levels[1:], size)))
    return F.when((token_estimate(text) <= size) & (F.length(text) <= 8 * size), F.array(text)).otherwise(parts)


def chunks(text: Column, size: int = SIZE, levels: tuple[str, ...] = DOCUMENT_LEVELS) -> Column:
    """Array of (content, tokens, start_char, end_char): pieces in order, packed as long as they fit. Joined, they are the text."""
    # A lambda over one value computes it once: neither a rendered text nor the tokens of a piece again for each use.
    return F.element_at(F.transform(F.array(text), lambda t: _packed(t, size, levels)), 1)


def _packed(text: Column, size: int, levels: tuple[str, ...]) -> Column:
    pieces = F.filter(_split(text, levels, size), lambda p: p != "")
    pieces = F.transform(pieces, lambda p: F.struct(p.alias("text"), token_estimate(p).alias("n")))
    empty = F.array().cast("array<struct<content:string,tokens:int,start_char:int,end_char:int>>")
    start = F.struct(empty.alias("done"), F.lit("").alias("open"), F.lit(0).alias("tokens"), F.lit(0).alias("at"))

    def closed(state: Column) -> Column:
        end = state["at"] + F.length(state["open"])
        return F.array_append(state["done"], F.struct(state["open"].alias("content"), state["tokens"].alias("tokens"), state["at"].alias("start_char"), end.alias("end_char")))

    def put(state: Column, piece: Column) -> Column:
        n, piece = piece["n"], piece["text"]
        fits = (state["tokens"] + n <= size) & (F.length(state["open"]) + F.length(piece) <= 8 * size)
        return F.struct(
            F.when(fits | (state["open"] == ""), state["done"]).otherwise(closed(state)).alias("done"),
            F.when(fits, F.concat(state["open"], piece)).otherwise(piece).alias("open"),
            F.when(fits, state["tokens"] + n).otherwise(n).alias("tokens"),
            F.when(fits, state["at"]).otherwise(state["at"] + F.length(state["open"])).alias("at"),
        )

    return F.aggregate(pieces, start, put, lambda state: F.when(state["open"] == "", state["done"]).otherwise(closed(state)))
