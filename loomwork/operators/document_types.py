"""How well each document type fits a text: weighted counts of its marks in the first characters, and the type that fits best.

Marks are counted by whole Arrow batches with linear-time regular expressions. The patterns stay in their Java dialect and are
put into that of the batches: a line ends at any of Java's line ends, \\s is ASCII with the vertical tab, no letter beyond ASCII is
another case of an ASCII one, and words end at letters and digits of any script. A null text has no marks.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import patterns as P

#: How many characters of a text the marks of types are counted in, by lines.
HEADS = (8000, 15000, 20000)
TYPES = ("legal", "academic", "qa", "table", "book", "email", "manual", "presentation", "resume")
_ENDS = r"\n\r\x{85}\x{2028}\x{2029}"
#: Letters beyond ASCII that a match without case takes for s and k, and what stands for them.
_LONG_S, _KELVIN, _FOR_KELVIN = "\u017f", "\u212a", "\ue001"

#: Patterns of lines with how many lines of a text they may count in.
_BULLETS = tuple("^(?:" + "|".join(s) + ")" for s in P.BULLET_SETS)
_ACADEMIC = P.any_of(P.flagged("i", P.ACADEMIC_SECTIONS))
_CHAPTERS, _PARTS = "|".join(P.BOOK_CHAPTERS), "|".join(P.BOOK_PARTS)
_SECTIONS = "|".join(P.any_of(p) for p in P.MANUAL_SECTIONS.values())
_STEPS = P.STEP + r"|^[•\-\*]\s+(.+)$|^[a-z]\)\s+(.+)$"
_CALLOUTS = "|".join(P.CALLOUTS)
_BREAKS, _SLIDE_BULLETS = P.any_of(P.flagged("i", P.SLIDE_BREAKS)), P.any_of(P.SLIDE_BULLETS)
_OF_LINES = (*_BULLETS, _ACADEMIC, _CHAPTERS, _PARTS, _SECTIONS, _STEPS, _CALLOUTS, _BREAKS, _SLIDE_BULLETS)


@lru_cache(None)
def batch_pattern(pattern: str) -> str:
    """A Java pattern for Arrow's functions. One that looks at the starts of lines needs texts with a line end before them:
    its counts go on behind each match, where a start of a text is none of a line."""
    by_line = re.search(r"\(\?[a-z]*m[a-z]*\)", pattern) is not None
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            c = pattern[i : i + 2]
            out.append((r"\t-\r " if inside else r"[\t-\r ]") if c == r"\s" else c)
        elif inside:
            out.append(c)
            inside = c != "]"
        elif c == "[":
            inside = True
            c = "[^" if pattern[i + 1] == "^" else c
            out.append(c)
        elif flags := re.match(r"\(\?([a-z]+)\)", pattern[i:]):
            c = flags[0]
            out.append("(?i)" if "i" in flags[1] else "")
        else:
            out.append({".": f"[^{_ENDS}]", "^": f"[{_ENDS}]" if by_line else "^", "$": rf"(?:\r\n|[{_ENDS}])?$"}.get(c, c))
        i += len(c)
    return "".join(out)


class _Words(dict):
    """Letters and digits beyond ASCII as underlines, marks on them as one private character."""

    def __missing__(self, c: int) -> int:
        kind = unicodedata.category(chr(c)) if c > 127 else ""
        self[c] = 95 if kind[:1] == "L" or kind == "Nd" or chr(c) == _FOR_KELVIN else 0xE000 if kind == "Mn" else c
        return self[c]


_WORDS = _Words()


def _words(texts: pa.Array) -> pa.Array:
    """Texts in which the ends of words are those of ASCII words; for patterns that ask for them."""
    if pc.all(pc.string_is_ascii(texts)).as_py() is not False:
        return texts
    told = [x if x.isascii() else re.sub("(?<=[A-Za-z0-9_])\ue000+", lambda m: "_" * len(m[0]), x.translate(_WORDS)) for x in texts.to_pylist()]
    return pa.array(told, texts.type)


def _low(texts: pa.Array) -> pa.Array:
    """Lower case as far as it is ASCII."""
    if pc.all(pc.string_is_ascii(texts)).as_py() is False:
        texts = pc.replace_substring(pc.replace_substring_regex(texts, f"[{_KELVIN}{_FOR_KELVIN}]", "k"), "\u0130", "i\u0307")
    return pc.ascii_lower(texts)


def _found(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


def _each(texts: pa.Array, patterns: tuple[str, ...], count: bool = True) -> list[np.ndarray]:
    """How often each pattern is in each text, or whether it is. Most texts have none and are read once."""
    patterns = tuple(map(batch_pattern, patterns))
    at = np.flatnonzero(_found(texts, P.any_of(patterns)))
    some = texts.take(pa.array(at)) if len(at) < len(texts) else texts
    out = []
    for p in patterns:
        n = np.zeros(len(texts), np.int64)
        if len(at):
            n[at] = pc.count_substring_regex(some, p).to_numpy(zero_copy_only=False) if count else _found(some, p)
        out.append(n)
    return out


class _Lines:
    """The stripped lines of texts that any of the patterns starts, with their text and place in it."""

    def __init__(self, lines: pa.Array):
        self.n = len(lines)
        ends = np.cumsum(pc.list_value_length(lines).to_numpy(zero_copy_only=False))
        flat = pc.ascii_trim_whitespace(lines.flatten())
        if pc.any(pc.match_substring_regex(flat, r"[\x{85}\x{2028}\x{2029}]$")).as_py():
            flat = pc.replace_substring_regex(flat, r"[\t-\r ]+([\x{85}\x{2028}\x{2029}])$", r"\1")
        at = np.flatnonzero(_found(flat, P.any_of(tuple(map(batch_pattern, _OF_LINES)))))
        self.lines, self.row = flat.take(pa.array(at)), np.searchsorted(ends, at, "right")
        self.place, self.words = at - np.concatenate([[0], ends])[self.row], _words(self.lines)

    def count(self, pattern: str, most: int) -> np.ndarray:
        hit = _found(self.words if r"\b" in pattern else self.lines, batch_pattern(pattern)) & (self.place < most)
        return np.bincount(self.row[hit], minlength=self.n)


def _scores(text: pa.Array, lines: pa.Array, name: pa.Array) -> pa.Array:
    text = pc.fill_null(text, "")
    if pc.any(pc.match_substring_regex(text, f"[{_LONG_S}{_KELVIN}]")).as_py():
        text = pc.replace_substring(pc.replace_substring(text, _LONG_S, "\u00e9"), _KELVIN, _FOR_KELVIN)
    size = pc.utf8_length(text).to_numpy(zero_copy_only=False)
    longest = size.max(initial=0)
    made: dict = {}

    def once(key, make):
        if key not in made:
            made[key] = make()
        return made[key]

    def part(n: int) -> pa.Array:
        return text if longest <= n else once(n, lambda: pc.utf8_slice_codeunits(text, 0, n))

    def words(x: pa.Array) -> pa.Array:
        return once(("words", id(x)), lambda: _words(x))

    def low(x: pa.Array) -> pa.Array:
        return once(("low", id(x)), lambda: _low(x))

    def led(x: pa.Array) -> pa.Array:
        """With a line end before it, for patterns of line starts."""
        return once(("led", id(x)), lambda: pc.binary_join_element_wise("\n", x, ""))

    def cut(n: int) -> _Lines:
        # The given lines are those of the longest head.
        if n == HEADS[-1] or longest <= n:
            return once("lines", lambda: _Lines(lines))
        return once(("lines", n), lambda: _Lines(pc.split_pattern(part(n), "\n")))

    def times(x: pa.Array, pattern: str) -> np.ndarray:
        return _each(x, (pattern,))[0]

    def capped(n: np.ndarray, weight: float, cap: float) -> np.ndarray:
        return np.minimum(n * weight, cap)

    def total(counts: list[np.ndarray], weight: float, cap: float) -> np.ndarray:
        return reduce(lambda a, b: a + b, [capped(n, weight, cap) for n in counts])

    names = pc.fill_null(name, "").dictionary_encode()
    named, which = _low(names.dictionary), names.indices.to_numpy()

    def bonus(pattern: str, x: float) -> np.ndarray:
        return np.where(_found(named, batch_pattern(pattern))[which], x, 0.0)

    legal, academic, book = words(part(8000)), P.ACADEMIC_INDICATORS, words(low(part(15000)))
    bullets = reduce(np.maximum, [cut(8000).count(p, 200) for p in _BULLETS])
    # The line starts are one pattern of the legal ones and are looked at in the texts themselves; an identifier takes what stands behind its last digit.
    legal_marks = [*_each(legal, P.LEGAL_INDICATORS[:-1]), times(led(part(8000)), P.LEGAL_INDICATORS[-1])]
    bounded = tuple(p.replace(r"[\d\-./]+", r"[\d\-./]*(?:\d\w*|[\-./])") for p in academic if r"\b" in p)
    by_words, by_text = iter(_each(legal, bounded)), iter(_each(part(8000), tuple(p for p in academic if r"\b" not in p)))
    academic_marks = [next(by_words if r"\b" in p else by_text) for p in academic]
    rows = times(led(part(15000)), r"(?m)^\s*\|.+\|")
    rules = times(led(part(15000)), r"(?m)^\s*\|[-:| ]+\|")
    all_lines = pc.count_substring(part(15000), "\n").to_numpy(zero_copy_only=False) + 1
    slide_bullets = cut(15000).count(_SLIDE_BULLETS, 100_000) / np.maximum(all_lines, 1)
    asks = [times(part(10000), r"\?"), *_each(led(part(10000)), (P.QA_FORMAT, r"(?im)^(?:Q\d*|question)\s*[:.)]|frequently\s+asked"))]
    heads = dict(zip(P.EMAIL_INDICATORS, _each(led(part(5000)), P.EMAIL_INDICATORS, count=False), strict=True))
    headed = [heads[P.EMAIL_INDICATORS[i]] for i in (0, 1, 2)]
    keywords = sum(_each(low(text), P.RESUME_KEYWORDS, count=False))
    resume_parts = sum(_each(led(text), tuple("(?m)" + p for p in P.RESUME_SECTIONS.values()), count=False))
    scores = {
        "legal": total(legal_marks, 0.08, 0.25) + capped(bullets, 0.04, 0.35)
        + bonus("contract|agreement|terms|policy|nda|legal|law|statute|regulation", 0.15),
        "academic": total(academic_marks, 0.05, 0.2) + capped(cut(15000).count(_ACADEMIC, 100_000), 0.1, 0.4)
        + total(_each(low(part(8000)), (r"\[\d+\]", r"\(\w+,?\s*\d{4}\)")), 0.02, 0.15) + bonus("paper|article|research|thesis|dissertation|journal|arxiv", 0.15),
        "qa": capped(asks[0], 0.02, 0.2) + capped(asks[1], 0.1, 0.3) + capped(asks[2], 0.08, 0.3) + bonus(r"faq|q\s*[&_]\s*a|questions?|quiz|exam|interview", 0.2),
        "table": np.where((rows > 2) & (rules > 0), capped(rows, 0.02, 0.3) + 0.2, 0.0) + capped(rows, 0.03, 0.25)
        + bonus(r"\.xlsx?$|\.csv$|data|report|spreadsheet|table", 0.15),
        "book": total(_each(book, P.BOOK_INDICATORS), 0.08, 0.25) + capped(cut(20000).count(_CHAPTERS, 500), 0.12, 0.35)
        + capped(cut(20000).count(_PARTS, 500), 0.15, 0.2) + np.where(_found(low(part(15000)), batch_pattern(r"table\s+of\s+contents?")), 0.15, 0.0)
        + bonus("book|novel|volume|manual|guide|handbook|edition", 0.1),
        "email": reduce(lambda a, b: a + b, [np.where(hit, 0.15, 0.0) for hit in heads.values()])
        + np.where((headed[0] & (headed[1] | headed[2])) > 0, 0.3, 0.0) + capped(times(part(5000), r"[\w.-]+@[\w.-]+\.\w+"), 0.05, 0.2)
        + bonus(r"\.(eml|msg)$", 0.3) + bonus("email|mail|message", 0.1),
        "manual": capped(cut(15000).count(_SECTIONS, 400), 0.1, 0.3) + capped(cut(15000).count(_STEPS, 400), 0.02, 0.2)
        + capped(cut(15000).count(_CALLOUTS, 400), 0.05, 0.15) + bonus("manual|guide|howto|how-to|install|setup|readme|documentation", 0.15),
        "presentation": capped(cut(15000).count(_BREAKS, 100_000), 0.1, 0.35)
        + np.where(slide_bullets > 0.3, 0.2, np.where(slide_bullets > 0.15, 0.1, 0.0)) + bonus(r"\.pptx?$|presentation|deck|slides|keynote|pitch", 0.25),
        "resume": capped(keywords, 0.05, 0.3) + capped(resume_parts, 0.05, 0.3) + np.where(_found(text, batch_pattern(P.RESUME_EMAIL)), 0.1, 0.0)
        + np.where(_found(text, batch_pattern(P.RESUME_PHONE)), 0.1, 0.0) + np.where(_found(low(text), "curriculum vitae|resume"), 0.2, 0.0),
    }
    return pa.StructArray.from_arrays([pa.array(np.minimum(scores[k], 1.0)) for k in TYPES], list(TYPES))


def _run(text: pa.Array, lines: pa.Array, name: pa.Array) -> pa.Array:
    """A batch in pieces of some megabytes, since several forms of its texts are held at once."""
    lines = lines if not lines.null_count else pa.array([[""] if x is None else x for x in lines.to_pylist()], lines.type)
    sizes, out, first = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)), [], 0
    while first < len(text):
        before = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, before + (16 << 20), "right")))
        out.append(_scores(text[first:last], lines[first:last], name[first:last]))
        first = last
    return pa.concat_arrays(out) if out else _scores(text, lines, name)


def text_lines(text: Column) -> Column:
    """The lines of a text's longest head."""
    return F.split(F.substring(text, 1, HEADS[-1]), "\n")


def confidences(text: Column, filename: Column, lines: Column | None = None) -> dict[str, Column]:
    """How well each document type fits, 0 to 1. ``lines``: ``text_lines`` where they are a column already."""
    run = F.arrow_udf(_run, "struct<" + ",".join(f"{k}:double" for k in TYPES) + ">")
    found = run(text, text_lines(text) if lines is None else lines, filename)
    return {k: found[k] for k in TYPES}


def classify(docs: DataFrame, text: str, filename: Column, least: float = 0.5) -> DataFrame:
    """``docs`` with document_type: the type that fits best, general below a threshold. Ties go to the first."""
    # Lines are cut once: what a generator gives is a column that no expression computes again.
    docs = docs.withColumn("_lines", F.explode(F.array(text_lines(F.col(text)))))
    scores = confidences(F.col(text), filename, F.col("_lines"))
    listed = F.array(*[F.struct(v.alias("score"), F.lit(-i).alias("i"), F.lit(k).alias("name")) for i, (k, v) in enumerate(scores.items())])
    best = docs.withColumn("_best", F.array_max(listed))
    return best.withColumn("document_type", F.when(F.col("_best.score") >= least, F.col("_best.name")).otherwise("general")).drop("_best", "_lines")
