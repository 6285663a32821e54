r"""Mail files: headers, nested parts, decoded bodies and attachments, read mail by mail in Arrow batches.

A line of two hyphens and a boundary that a multipart header of the mail declares begins a part, or with two hyphens more ends
a list of parts; what follows an end up to the next such line is no part. A header belongs to the mail or to a part if
it stands before the first empty line there, so boundaries inside a forwarded message cut nothing. A mail stays in its row:
nothing of it is shuffled; mails are spread.

Bodies are decoded by their transfer encoding (base64, quoted-printable, else as they are) and their charset: the named one
where it is UTF-8, ASCII or Latin-1, else UTF-8 where the bytes allow it, else Latin-1. Line ends (CR, LF or both, no other characters) become "\n".
Defined results: null and empty files have no part; broken base64 is an empty payload; a part without a type is plain text; repeated headers
count once, the first; a list of parts that is never closed ends with the file.
"""

from __future__ import annotations

import re
from binascii import a2b_base64, a2b_qp
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomwork.session import spread

#: Headers that are kept; the first ones lead the text of headers.
HEADERS = ("From", "To", "Cc", "Subject", "Date", "Bcc", "Reply-To", "Message-ID", "In-Reply-To", "References")
BOUNDARY = re.compile(r'(?i)content-type:[ \t]*multipart/(?:[^\n]|\n[ \t])*?(?<=[; \t])boundary[ \t]*=[ \t]*"?([^"\n;]+)', re.A)
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'))
#: Types of attachments whose text is given.
READ_TYPES = ("text/plain", "text/markdown", "text/csv", "application/json", "text/html")
#: How many bytes of results are handed on at once.
GIVEN_BYTES = 16 << 20

_SHOWN = tuple((h.lower(), f"{h.title()}: ") for h in HEADERS)
_NAMES = frozenset((*(name for name, _ in _SHOWN), "content-type", "content-disposition", "content-transfer-encoding"))
_BLANK, _BLANK_FIRST = re.compile(r"\n[ \t]*(?=\n|\Z)"), re.compile(r"[ \t]*(?=\n|\Z)")
_FOLD = re.compile(r"\n[ \t]+")
_NOT_BASE64 = bytes({*range(256)} - {*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="})
_SOFT_BREAK, _LINE_TAIL, _HEXED = re.compile(rb"=[ \t]*\n"), re.compile(rb"(?m)[ \t]+$"), re.compile(rb"(?:=[0-9A-Fa-f]{2})+")
_ENCODED = r"=\?([^?\s]+)\?([BbQq])\?([^?]*)\?="
_WORD, _WORD_GAP = re.compile(_ENCODED, re.A), re.compile(r"(\?=)[ \t]+(=\?)")
_QUIET, _TAG, _SPACE = re.compile(r"(?is)<(script|style)[^>]*>.*?</\1>", re.A), re.compile(r"<[^>]+>"), re.compile(r"\s+", re.A)
_FORMS = {
    name: tuple(
        re.compile(rf"(?i)(?:^|[;\s]){name}{form}", re.A) for form in (r"\*\s*=\s*([^'\s;]*)'[^']*'([^;\s]+)", r'\s*=\s*"([^"]*)"', r'\s*=\s*([^";\s]+)')
    )
    for name in ("charset", "filename", "name")
}


class Kind(NamedTuple):
    """What the headers of a part say of its body."""

    content_type: str
    charset: str | None
    disposition: str | None
    filename: str | None
    way: str | None


def quoted_printable(data: bytes, word: bool = False) -> bytes:
    """Bytes of quoted-printable text; in words of headers an underline is a space."""
    data = _SOFT_BREAK.sub(b"", data) if b"= " in data or b"=\t" in data else data.replace(b"=\n", b"")
    if word:
        data = data.replace(b"_", b" ")
    elif b" \n" in data or b"\t\n" in data or data[-1:] in (b" ", b"\t"):
        data = _LINE_TAIL.sub(b"", data)
    if b"=" not in data:
        return data
    # The library drops a sign at the end, one of two and one before a line end.
    if b"==" in data or b"=\n" in data or data[-1:] == b"=":
        return _HEXED.sub(lambda m: bytes.fromhex(m[0].replace(b"=", b"").decode()), data)
    return a2b_qp(data)


def base64(data: bytes) -> bytes:
    data = data.translate(None, _NOT_BASE64)
    core = data.rstrip(b"=")
    pads, rest = len(data) - len(core), len(core) % 4
    broken = b"=" in core or pads > 2 or ((rest + pads) % 4 if pads else rest == 1)
    return b"" if broken else a2b_base64(core + b"=" * (-len(core) % 4))


def decoded_text(data: bytes, charset: str | None) -> str:
    if (charset or "utf-8").lower() not in ("iso-8859-1", "latin1", "latin-1"):
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def header_words(value: str | None) -> str | None:
    """A header's value with its encoded words decoded; white space between two of them goes."""
    if value is None or ("=?" not in value and value.isascii()):
        return value
    out, at = [], 0
    value = _WORD_GAP.sub(r"\1\2", value)
    for m in _WORD.finditer(value):
        out.append(decoded_text(value[at : m.start()].encode("latin-1"), None))
        data, at = m[3].encode("latin-1"), m.end()
        out.append(decoded_text(base64(data) if m[2] in "Bb" else quoted_printable(data, word=True), m[1]))
    return "".join([*out, decoded_text(value[at:].encode("latin-1"), None)])


def headers(head: str) -> dict[str, str]:
    """The first header of each name (in lower case), unfolded; none that is empty."""
    found: dict[str, str] = {}
    for line in (_FOLD.sub(" ", head) if "\n " in head or "\n\t" in head else head).split("\n"):
        name, colon, value = line.partition(":")
        name = name.lower()
        if colon and name in _NAMES and name not in found:
            found[name] = value.lstrip(" \t").rstrip(" ")
    return {k: v for k, v in found.items() if v} if "" in found.values() else found


def _parameter(value: str | None, name: str) -> str | None:
    """A parameter of a header: one with a charset of its own is decoded by it, any other by its encoded words."""
    if value is None or name not in value.lower():
        return None
    coded, quoted, plain = _FORMS[name]
    if "*" in value and (m := coded.search(value)):
        return decoded_text(quoted_printable(m[2].replace("%", "=").encode("latin-1")), m[1])
    return header_words(next((m[1] for form in (quoted, plain) if (m := form.search(value)) and m[1]), None))


@lru_cache(4096)
def _kind(kind: str | None, place: str | None, way: str | None) -> Kind:
    named = _parameter(place, "filename")
    named = _parameter(kind, "name") if named is None else named
    content_type = "text/plain" if kind is None else kind.split(";", 1)[0].strip(" ").lower()
    return Kind(content_type, _parameter(kind, "charset"), place and place.lower(), named, way and way.lower())


def kind_of(found: dict[str, str]) -> Kind:
    return _kind(found.get("content-type"), found.get("content-disposition"), found.get("content-transfer-encoding"))


def _cut(text: str, bounds: set[str]) -> list[tuple[int, int, int, int, int]]:
    """(part, first character and end of its head, of its body) between the lines that ``bounds`` make edges; ended lists have none."""
    out, n, first, gone, size = [], 0, 0, False, len(text)
    at = (0 if text.startswith("--") else text.find("\n--") + 1 or -1) if bounds else -1
    while first <= size:
        opens, end = True, size + 1
        while at >= 0:
            end = text.find("\n", at)
            end = size if end < 0 else end
            said = text[at:end].rstrip(" ")
            opens = said[2:] in bounds
            if opens or (said[-2:] == "--" and said[2:-2] in bounds):
                break
            at = text.find("\n--", end) + 1 or -1
        last = at - 1 if at >= 0 else size
        # An edge right behind another one, or at the very start, leaves no line between them.
        if not gone and last >= first:
            blank = first == last or text[first] in " \t\n"
            blank = (blank and _BLANK_FIRST.match(text, first, last)) or _BLANK.search(text, first, last)
            out.append((n, first, blank.start(), min(blank.end() + 1, last), last) if blank else (n, first, last, last, last))
        if at < 0:
            break
        n, first, gone = n + 1, end + 1, not opens
        at = text.find("\n--", end) + 1 or -1
    return out


def _named(text: str) -> list[tuple[int, int, str]]:
    """(first character, end, boundary) of the lines that read like multipart headers."""
    out, low = [], "\n" + text.lower()
    at = low.find("\ncontent-type:")
    while at >= 0:
        end = at + 1
        if m := BOUNDARY.match(text, at):
            end = m.end()
            out.append((at, end, m[1].rstrip(" ")))
        at = low.find("\ncontent-type:", end)
    return out


def parts_of(data: bytes) -> list[tuple[int, str, str]]:
    """(part, head, body as it is) of a mail in order; part 0 is the mail."""
    text = data.decode("latin-1")
    text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    found = _named(text)
    named = {x[2] for x in found}
    parts = _cut(text, named)
    if found:
        # Of all boundaries that are named somewhere, those that headers declare.
        heads = [(first, end) for _, first, end, _, _ in parts]
        declared = {x for a, b, x in found for first, end in heads if first <= a and b <= end}
        parts = parts if declared == named else _cut(text, declared)
    return [(n, text[first:end], text[body:last]) for n, first, end, body, last in parts]


def payload_of(body: str, way: str | None) -> bytes:
    data = body.encode("latin-1")
    return base64(data) if way == "base64" else quoted_printable(data) if way == "quoted-printable" else data


def stripped_html(html: str) -> str:
    """Text of HTML: no scripts and styles, tags as spaces, white space collapsed, then the common entities."""
    text = _QUIET.sub("", html) if "<s" in html or "<S" in html else html
    text = _SPACE.sub(" ", _TAG.sub(" ", text))
    for entity, character in ENTITIES if "&" in text else ():
        text = text.replace(entity, character)
    return text.strip(" ")


def content_of(parts: list[tuple[int, str, str]]) -> tuple[str, list[tuple], bool, bool]:
    """(content, attachments, has_html, has_plain_text) of a mail."""
    plain, pages, items, meta, said = [], [], [], [], {}
    for part, head, body in parts:
        found = headers(head)
        if part == 0:
            said = found
        p = kind_of(found)
        attached = part > 0 and p.disposition is not None and "attachment" in p.disposition
        kept = plain if p.content_type == "text/plain" else pages if p.content_type == "text/html" else None
        if kept is None and not attached:
            continue
        payload = payload_of(body, p.way)
        text = decoded_text(payload, p.charset) if p.content_type in READ_TYPES else ""
        text = stripped_html(text) if kept is pages else text
        if kept is not None and payload:
            kept.append(text)
        if attached:
            name, size = "None" if p.filename is None else p.filename, len(payload)
            inner = f"\n\n### Attachment: {name}\n{text}\n" if text else ""
            items.append(f"- {name} ({p.content_type}, {size / 1024:.1f} KB){inner}")
            meta.append((p.filename, p.content_type, size))
    heads = "\n".join([shown + header_words(said[name]) for name, shown in _SHOWN if name in said])
    told = "\n".join(plain or pages) or "(No text content)"
    sections = [f"## Email Headers\n{heads}\n", f"## Email Body\n{told}\n"]
    if items:
        sections.append("## Attachments\n" + "\n".join(items))
    return "\n".join(sections), meta, bool(pages), bool(plain)


def told_of(parts: list[tuple[int, str, str]]) -> list[tuple]:
    """The parts of a mail with what their headers say and their decoded bodies."""
    kinds = [(n, head, body, kind_of(headers(head))) for n, head, body in parts]
    return [(n, head, *k[:4], payload_of(body, k.way)) for n, head, body, k in kinds]


def _read(mails: DataFrame, key: str, data: str, told: str, rows_of: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """(key, ``told``): the rows that ``rows_of`` makes of each mail, some megabytes at once."""
    rows = spread(mails.select(key, data))
    schema = StructType([rows.schema[key], *StructType.fromDDL(told).fields])
    shape = to_arrow_schema(schema)

    def packed(keys: pa.Array, at: list[int], made: list[tuple]) -> pa.RecordBatch:
        columns = zip(*made, strict=True) if made else [[] for _ in shape][1:]
        own = [pa.array(c, f.type) for c, f in zip(columns, list(shape)[1:], strict=True)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())).cast(shape[0].type), *own], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made, size = [], [], 0
            step = max(1, batch.num_rows * GIVEN_BYTES // max(GIVEN_BYTES, batch.nbytes))
            for first in range(0, batch.num_rows, step):
                for i, mail in enumerate(batch.column(1).slice(first, step).to_pylist(), first):
                    if not mail:
                        continue
                    for row in rows_of(parts_of(mail)):
                        at.append(i)
                        made.append(row)
                    size += len(mail)
                    if size >= GIVEN_BYTES:
                        yield packed(batch.column(0), at, made)
                        at, made, size = [], [], 0
            yield packed(batch.column(0), at, made)

    return rows.mapInArrow(run, schema)


def mail_parts(mails: DataFrame, key: str, data: str) -> DataFrame:
    """(key, part, head, content_type, charset, disposition, filename, payload): the parts of mails in order; part 0 is the mail."""
    told = "part int, head string, content_type string, charset string, disposition string, filename string, payload binary"
    return _read(mails, key, data, told, told_of)


def mail_contents(mails: DataFrame, key: str, data: str) -> DataFrame:
    """(key, content, attachments, has_html, has_plain_text): the text of mails in sections for headers, body and attachments.

    Plain texts come before HTML, which only counts where there is none. An attachment is a part whose disposition says so:
    (filename, content_type, size). A mail without parts has no row.
    """
    told = "content string, attachments array<struct<filename:string,content_type:string,size:int>>, has_html boolean, has_plain_text boolean"
    return _read(mails, key, data, told, lambda parts: [content_of(parts)] if parts else [])
