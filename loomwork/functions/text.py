"""Text functions on columns: normalising, cleaning, summaries, redaction, cell and line predicates. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension to content type.
MIME_BY_EXTENSION = {
    "eml": "message/rfc822",
    "msg": "application/vnd.ms-outlook",
    "pdf": "application/pdf",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "txt": "text/plain",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "rst": "text/x-rst",
    "csv": "text/csv",
    "tsv": "text/tab-separated-values",
    "json": "application/json",
    "jsonl": "application/jsonl",
    "xml": "application/xml",
    "yaml": "application/x-yaml",
    "yml": "application/x-yaml",
    "mp3": "audio/mpeg",
    "wav": "audio/wav",
    "flac": "audio/flac",
    "m4a": "audio/mp4",
    "ogg": "audio/ogg",
    "mp4": "video/mp4",
    "avi": "video/x-msvideo",
    "mov": "video/quicktime",
    "webm": "video/webm",
    "mkv": "video/x-matroska",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "webp": "image/webp",
    "svg": "image/svg+xml",
    "bmp": "image/bmp",
    "tiff": "image/tiff",
    "tif": "image/tiff",
}
#: Parser by content type, in the order in which they claim it. HTML goes to the video-page parser.
PARSERS = (
    ("slides", r"^application/vnd\.(ms-powerpoint|openxmlformats-officedocument\.presentationml\.presentation)$"),
    ("sheet", r"^application/vnd\.(ms-excel|openxmlformats-officedocument\.spreadsheetml\.sheet)$"),
    ("json", r"^(application/(json|jsonl|x-jsonlines|x-ndjson)|text/json)$"),
    ("email", r"^(message/rfc822|application/vnd\.ms-outlook)$"),
    ("document", r"^application/(pdf|msword|vnd\.openxmlformats-officedocument\.wordprocessingml\.document)$"),
    ("video_page", r"^(text/html|video/youtube|application/x-youtube)$"),
    ("video", r"^video/"),
    ("audio", r"^audio/"),
    ("image", r"^image/(png|jpeg|jpg|webp|gif|bmp|tiff)$"),
    ("text", r"^text/"),
)
#: Other names of document types.
TYPE_ALIASES = {
    "law": "legal", "contract": "legal", "legislation": "legal", "research": "academic", "paper": "academic",
    "scientific": "academic", "faq": "qa", "question": "qa", "exam": "qa", "tabular": "table", "spreadsheet": "table",
    "data": "table", "novel": "book", "chapter": "book", "volume": "book", "correspondence": "email", "mail": "email",
    "message": "email", "guide": "manual", "documentation": "manual", "technical": "manual", "howto": "manual",
    "how-to": "manual", "slides": "presentation", "deck": "presentation", "powerpoint": "presentation",
    "ppt": "presentation", "cv": "resume", "curriculum": "resume", "other": "general", "none": "general",
    "unknown": "general",
}
#: Secrets and what replaces them.
SECRETS = (
    (r"mn_[a-zA-Z0-9_]{32,}", "mn_***REDACTED***"),
    (r"sk-[a-zA-Z0-9]{32,}", "sk-***REDACTED***"),
    (r"Bearer\s+[a-zA-Z0-9_\-\.]+", "Bearer ***REDACTED***"),
)
SENSITIVE_KEYS = ("authorization", "x-api-key", "cookie", "x-auth-token", "api-key", "apikey")
#: Kinds of table cells, first match wins.
CELL_KINDS = (
    (r"^(20|19)[0-9]{2}[年/-][0-9]{1,2}[月/-][0-9]{1,2}日*$", "date"),
    (r"^(20|19)[0-9]{2}年$", "date"),
    (r"^(20|19)[0-9]{2}[年-][0-9]{1,2}月*$", "date"),
    (r"^[0-9]{1,2}[月-][0-9]{1,2}日*$", "date"),
    (r"^Q[1-4]\s*(20|19)?[0-9]{2}$", "date"),
    (r"^(20|19)[0-9]{2}[ABCDE]$", "date"),
    (r"^[0-9.,+%/ -]+$", "numeric"),
    (r"^-?\d+\.?\d*$", "numeric"),
    (r"^-?\d{1,3}(,\d{3})*(\.\d+)?$", "numeric"),
    (r"^[0-9A-Z/\._~-]+$", "code"),
    (r"^[A-Z]*[a-z' -]+$", "text_en"),
    (r"^[0-9.,+-]+[0-9A-Za-z/$%<>()' -]+$", "mixed"),
    (r"^.{1}$", "single"),
)
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10}
NUMBER_WORDS = {
    w: i
    for i, w in enumerate(
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
        "seventeen eighteen nineteen twenty".split()
    )
}


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed map; null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def content_type(filename: Column, client: Column) -> Column:
    """By extension, else what the client says unless that is generic, else the generic type."""
    extension = F.lower(F.regexp_extract(filename, r"\.([^./]+)$", 1))
    generic = "application/octet-stream"
    return F.coalesce(lookup(MIME_BY_EXTENSION, extension), F.when(client != generic, client), F.lit(generic))


def parser_for(mime: Column) -> Column:
    """Name of the first parser that claims a content type; null if none does."""
    out = F.when(mime.rlike(PARSERS[0][1]), PARSERS[0][0])
    for name, pattern in PARSERS[1:]:
        out = out.when(mime.rlike(pattern), name)
    return out


def search_normal(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"[/\-_]", " "), r"\s+", " "))


def table_row_text(line: Column) -> Column:
    """Cells of a pipe row, without blank and ruling ones."""
    cells = F.filter(F.transform(F.split(line, r"\|"), strip), lambda x: (x != "") & ~x.rlike(r"^[\s\-:]+$"))
    return F.array_join(cells, " | ")


def rag_clean(c: Column) -> Column:
    """Markdown made fit for retrieval: comments, table rules and stray marks go, rows become ``a | b``. Order matters."""
    c = F.regexp_replace(c, r"<!--[^>]*-->", "")
    c = F.regexp_replace(c, r"\|[\s\-:]+\|[\s\-:|]*\n?", "\n")

    def row(line: Column) -> Column:
        text = table_row_text(line)
        return F.when(~line.rlike(r"^\|[^\n]+\|$"), line).when(text == "", "").otherwise(F.concat(text, F.lit("\n")))

    c = F.array_join(F.transform(F.split(c, "\n"), row), "\n")
    c = F.regexp_replace(c, r"\|\s*\|", "")
    c = F.regexp_replace(c, r"(?m)^\|\s*$", "")
    c = F.regexp_replace(c, r"[·•]\s*", "- ")
    c = F.regexp_replace(c, r"(?m)^\s*-\s*$", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: ~x.rlike(r"^[\s\-|_*#=]+$"))
    return strip(F.array_join(lines, "\n"))


def table_to_sentences(c: Column) -> Column:
    """Rows of a pipe table as ``Header: value, ...``; rows of another width as their cells."""
    lines = F.split(strip(c), "\n")

    def cells(line: Column) -> Column:
        return F.filter(F.transform(F.split(line, r"\|"), strip), lambda x: x != "")

    heads = cells(F.element_at(lines, 1))
    rows = F.filter(F.slice(lines, 2, F.size(lines)), lambda x: ~x.rlike(r"^[\s\-|:]+$"))

    def sentence(line: Column) -> Column:
        found = cells(line)
        paired = F.array_join(F.zip_with(heads, found, lambda h, v: F.concat(h, F.lit(": "), v)), ", ")
        return F.when(F.size(found) == F.size(heads), paired).otherwise(F.array_join(found, " "))

    made = F.array_join(F.filter(F.transform(rows, sentence), lambda x: x != ""), "\n")
    return F.when(F.size(lines) < 2, c).otherwise(made)


def html_strip(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    c = F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return strip(c)


def summary(title: Column, filename: Column, content: Column, chars: int = 2000) -> Column:
    return F.concat_ws(
        "\n",
        F.when(title != "", F.concat(F.lit("Title: "), title)),
        F.when(filename != "", F.concat(F.lit("File: "), filename)),
        F.when(content != "", strip(F.substring(content, 1, chars))),
    )


def token_estimate(c: Column) -> Column:
    return F.floor(F.regexp_count(c, F.lit(r"\S+")) * 4 / 3).cast("int")


def excerpt(c: Column, chars: int = 3000) -> Column:
    """A text of at most ``chars``, else its first two thirds of them and a third from its middle."""
    c = strip(c)
    first = chars * 2 // 3
    middle = chars - first
    start = F.floor((F.length(c) - middle) / 2).cast("int")
    long = F.concat(F.substring(c, 1, first), F.lit("\n\n[...]\n\n"), F.substr(c, start + 1, F.lit(middle)))
    return F.when(F.length(c) <= chars, c).otherwise(long)


def type_label(c: Column) -> Column:
    """The document type a free answer names."""
    c = strip(F.lower(c))
    for suffix in (" document", " paper", " content", " format", " type"):
        c = F.regexp_replace(c, f"{suffix}$", "")
    return F.coalesce(lookup(TYPE_ALIASES, c), c)


def redact(c: Column) -> Column:
    for pattern, instead in SECRETS:
        c = F.regexp_replace(c, pattern, instead.replace("$", r"\$"))
    return c


def redact_map(c: Column) -> Column:
    """A map with the values of sensitive keys hidden."""
    return F.map_zip_with(
        c, c, lambda k, v, _: F.when(F.lower(k).isin(*SENSITIVE_KEYS), F.lit("***REDACTED***")).otherwise(v)
    )


def index_number(c: Column) -> Column:
    """Digits, number words up to twenty or Roman numerals up to ten as a number, else -1."""
    c = strip(c)
    digits = F.when(c.rlike(r"^[+-]?\d+$"), F.try_to_number(c, F.lit("S9999999999")).cast("int"))
    return F.coalesce(digits, lookup(NUMBER_WORDS, F.lower(c)), lookup(ROMAN, F.upper(c)), F.lit(-1))


def not_bullet(line: Column) -> Column:
    return line.rlike(r"^(?:0|[0-9]+ +[0-9~-]|[0-9]+\.{2,})")


def not_title(c: Column) -> Column:
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return (words > 12) | ((F.instr(c, " ") == 0) & (F.length(c) >= 32)) | c.rlike(r"[,;?!]")


def cell_kind(c: Column) -> Column:
    c = strip(c)
    out = F.when(c == "", "empty")
    for pattern, kind in CELL_KINDS:
        out = out.when(c.rlike(pattern), kind)
    words = F.size(F.split(c, r"\s+"))
    return out.when(words >= 12, "long_text").when(words > 3, "text").otherwise("other")


def looks_like_header(c: Column) -> Column:
    letters = F.length(F.regexp_replace(c, r"[^A-Za-z]", ""))
    return (F.length(c) > 0) & (c.rlike(r"[^\x00-\x7F]") | (letters >= 2) | c.rlike(r"[():/_\-]"))


def looks_like_data(c: Column) -> Column:
    return (
        F.upper(c).isin("Y", "N", "M", "X", "/", "-")
        | F.regexp_replace(c, r"[.,\-]", "").rlike(r"^\d+$")
        | (F.startswith(c, F.lit("0x")) & (F.length(c) <= 10))
    )


def decode_slug(c: Column) -> Column:
    """Words of a slug up to the first part that mixes letters and digits."""
    parts = F.split(c, "-")
    mixed = F.transform(parts, lambda p: p.rlike("^[A-Za-z0-9]+$") & p.rlike("[A-Za-z]") & p.rlike("[0-9]"))
    stop = F.array_position(mixed, True)
    return F.array_join(F.when(stop > 0, F.slice(parts, 1, (stop - 1).cast("int"))).otherwise(parts), " ")


def follow_ups(query: Column, mode: Column, space: str | None = None) -> Column:
    """Up to three follow-up questions by the query's question word and the search mode.

    The last word is what stands behind the last white space of any kind, or behind the last ``space`` alone.
    """
    low = F.lower(query)
    last = F.element_at(F.split(strip(query), r"\s+"), -1) if space is None else F.substring_index(query, space, -1)
    first = (
        F.when(F.instr(low, "what") > 0, F.array(F.concat(F.lit("Can you provide examples related to "), last, F.lit("?")), F.lit("How does this work in practice?")))
        .when(F.instr(low, "how") > 0, F.array(F.lit("What are the key steps involved?"), F.lit("Are there any alternative approaches?")))
        .when(F.instr(low, "why") > 0, F.array(F.lit("What are the benefits of this approach?"), F.lit("Are there any drawbacks?")))
        .otherwise(F.array(F.lit("Can you explain this in more detail?"), F.lit("What are the key takeaways?")))
    )
    third = (
        F.when(mode == "graph", "How do these concepts relate to each other?")
        .when(mode == "semantic", "Are there similar concepts in the documents?")
        .otherwise("Can you summarize the main points?")
    )
    return F.concat(first, F.array(third))


def video_id(url: Column) -> Column:
    """The id in a video page's address (watch, embed, v and short links); null for other addresses."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    full = host.isin("www.youtube.com", "youtube.com", "m.youtube.com")
    return (
        F.when(host == "youtu.be", F.nullif(F.substring(path, 2, 10_000), F.lit("")))
        .when(full & (path == "/watch"), F.nullif(F.regexp_extract(url, r"[?&]v=([^&#]*)", 1), F.lit("")))
        .when(full & path.rlike("^/(embed|v)/"), F.nullif(F.regexp_extract(path, r"^/(?:embed|v)/([^/]*)", 1), F.lit("")))
    )


def clock(seconds: Column) -> Column:
    """Seconds as MM:SS."""
    whole = F.floor(seconds).cast("long")
    return F.concat_ws(":", *[F.lpad(x.cast("string"), F.greatest(F.lit(2), F.length(x.cast("string"))), F.lit("0")) for x in (F.floor(whole / 60).cast("long"), whole % 60)])
