"""JSON documents in chunks of bounded size that keep their structure.

A document is opened, measured and dealt inside its row: keys in their own order, lists as objects whose keys are the indexes.
Spark says which texts are JSON and writes their values (``to_json`` of the parsed text, whose keys are sorted); a small
helper walks both forms in Arrow batches. A fold whose state is the open chunk deals the items: one that fits goes in whole,
one that does not begins a new chunk where the open one is large enough, and is dealt by its own items; a value that fits
nowhere makes a chunk larger than the bound. Chunks are written from their nodes and the keys above them.

Defined results: null, empty and malformed texts, and objects with a key twice, have no chunk; neither have single values and
empty containers at the top; an empty container counts as a value; all other values come back in exactly one chunk.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: Characters of a chunk in its compact form, and those from which on it may be closed.
MOST, LEAST = 4000, 1800
DEEPEST = 100


#: Nodes that a task hands on at once.
HANDED_ON = 20_000

_ESCAPES = re.compile(r"\\(?:u[0-9a-f]{4}|.)")


class _Number(str):
    """A number as Spark writes it."""


_OWN = json.JSONDecoder(parse_int=_Number, parse_float=_Number, strict=False)


def _parsed(text: str) -> dict | list:
    return _OWN.raw_decode(text)[0]


def _quoted(text: str) -> str:
    """``text`` as ``to_json`` writes it."""
    plain = encode_basestring(text)
    return _ESCAPES.sub(lambda m: "\\u" + m[0][2:].upper() if len(m[0]) > 2 else m[0], plain) if "\\u" in plain else plain


def _value(x: object) -> str:
    return x if type(x) is _Number else _quoted(x) if isinstance(x, str) else "{}" if isinstance(x, (dict, list)) else json.dumps(x)


@lru_cache(4096)
def _key(key: str) -> tuple[str, str]:
    """A key as Spark holds it, and quoted."""
    held = key.encode("utf-8", "replace").decode()
    return held, _quoted(held)


def _nodes(own: dict | list, typed: dict | list, depth: int = 1) -> list[tuple[str, str | None, list, int]]:
    """(quoted key, value, items, size) of all items, keys and order from ``own``, values from ``typed``; size: characters of
    {key: value} in compact form."""
    if depth > DEEPEST:
        raise ValueError(f"a document is nested more than {DEEPEST} levels deep")
    if isinstance(own, dict):
        found = [(quoted, inner, typed[held]) for (held, quoted), inner in ((_key(k), x) for k, x in own.items())]
    else:
        found = [(f'"{n}"', inner, typed[n]) for n, inner in enumerate(own)]
    out = []
    for key, inner, value in found:
        if value and isinstance(value, (dict, list)):
            items = _nodes(inner, value, depth + 1)
            out.append((key, None, items, len(key) + 4 + sum([x[3] for x in items])))
        else:
            value = _value(value)
            out.append((key, value, [], len(key) + 4 + len(value)))
    return out


def _flat(nodes: list, place: list[int], path: list[str], out: list) -> list[tuple[list[int], list[str], str | None]]:
    """``out`` with (place, path, value) of all nodes in order."""
    for n, (key, value, items, _) in enumerate(nodes):
        here, keys = [*place, n], [*path, key]
        out.append((here, keys, value))
        if items:
            _flat(items, here, keys, out)
    return out


def _put(node: tuple, depth: int, chunk: list) -> None:
    chunk.append((node[0], depth, node[1]))
    for x in node[2]:
        _put(x, depth + 1, chunk)


def _written(chunk: list[tuple[str, int, str | None]]) -> str:
    """A chunk with two spaces a level."""
    lines = ["{"]
    for (key, depth, value), (_, after, _) in zip(chunk, [*chunk[1:], ("", 0, None)], strict=True):
        lines.append(f"{'  ' * depth}{key}: {'{' if value is None else value}{',' if after == depth else ''}")
        lines += [f"{'  ' * d}}}{',' if d == after and d else ''}" for d in range(depth - 1, after - 1, -1)]
    return "\n".join(lines)


def _chunks(nodes: list, most: int, least: int) -> list[tuple[str, int, int]]:
    """(content, n_chars, nodes) of the chunks of a document."""
    chunks, sizes, last = [[]], [2], []

    def deal(items: list, above: list) -> None:
        nonlocal last
        for x in items:
            fits = x[3] < most - sizes[-1]
            if not fits and sizes[-1] >= least:
                chunks.append([])
                sizes.append(2)
                last = []
            if not fits and x[2]:
                deal(x[2], [*above, x])
                continue
            shared = next((i for i, (a, b) in enumerate(zip(above, last, strict=False)) if a is not b), min(len(above), len(last)))
            sizes[-1] += (2 if chunks[-1] else 0) + sum(len(a[0]) + 4 for a in above[shared:]) + x[3] - 2
            chunks[-1] += [(a[0], i + 1, None) for i, a in enumerate(above) if i >= shared]
            _put(x, len(above) + 1, chunks[-1])
            last = above

    deal(nodes, [])
    return [(_written(c), n, len(c)) for c, n in zip(chunks, sizes, strict=True) if c]


def _by_document(schema: pa.Schema, rows_of: Callable[[list], list[tuple[tuple, int]]]):
    """Batches of (key, text, typed text) to those of the key with the rows that ``rows_of`` makes of a document's nodes; it says
    with each row how many nodes are in it."""

    def made(keys: pa.Array, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(zip(*rows, strict=True), list(schema)[1:], strict=True)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *(pa.array(x, f.type) for x, f in columns)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, held = [], [], 0
            for i in range(batch.num_rows):
                typed = batch[2][i].as_py()
                for row, n in rows_of(_nodes(_parsed(batch[1][i].as_py()), _parsed(typed))) if typed else ():
                    at.append(i)
                    rows.append(row)
                    held += n
                    if held >= HANDED_ON:
                        yield made(batch[0], at, rows)
                        at, rows, held = [], [], 0
            if rows:
                yield made(batch[0], at, rows)

    return run


def _opened(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, typed): documents as they stand and as Spark writes them, null where they are no object or list."""
    trimmed = F.trim(F.col(text))
    typed = F.when(trimmed.rlike(r"^[\[{]"), F.to_json(F.try_parse_json(F.col(text))))
    return docs.select(key, trimmed.alias("text"), typed.alias("typed"))


def json_nodes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, path, widths, value, is_leaf): all nodes of the documents. ``place``: the numbers of a node and of those
    above it among their siblings, which orders nodes; ``path``: their quoted keys; ``widths``: the keys' characters."""
    opened = _opened(docs, key, text)
    schema = StructType([opened.schema[key]]).add("place", ArrayType(IntegerType())).add("path", ArrayType(StringType())).add("value", "string")
    run = _by_document(to_arrow_schema(schema), lambda found: [(x, 1) for x in _flat(found, [], [], [])])
    widths = F.transform("path", lambda k: F.length(k) + 2)
    return opened.mapInArrow(run, schema).select(key, "place", "path", widths.alias("widths"), "value", F.col("value").isNotNull().alias("is_leaf"))


def split_json(docs: DataFrame, key: str, text: str, most: int = MOST, least: int = LEAST) -> DataFrame:
    """(key, chunk, content, n_chars): chunks of each document, written with two spaces a level; n_chars of the compact form."""
    opened = _opened(docs, key, text)
    schema = StructType([opened.schema[key]]).add("chunk", "integer").add("content", "string").add("n_chars", "integer")
    run = _by_document(to_arrow_schema(schema), lambda found: [((i, *c[:2]), c[2]) for i, c in enumerate(_chunks(found, most, least))])
    return opened.mapInArrow(run, schema)
