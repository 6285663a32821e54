"""Entries of resumes: education, experience, certifications, languages and the place, as columns on the text of one row.

Defined results: a section without a header is empty; an entry has nulls for what it doesn't name; lists keep the order of the
text and end after 5 schools, 10 jobs, 10 certifications and 10 languages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import patterns as P
from loomwork.functions.text import strip
from loomwork.operators.structure import section_body


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(strip(F.regexp_extract(text, pattern, group)), F.lit(""))


#: A date whose years are numbers of their own, no part of a name or of a longer number.
DATE = rf"(?<!\w)(?:{P.RESUME_DATE})(?!\d)"


def _lines(entry: Column) -> Column:
    return F.transform(F.split(strip(entry), "\n"), lambda x: strip(x))


def _dated(line: Column) -> Column:
    return line.rlike(f"^{DATE}")


def _dates(entry: Column) -> Column:
    """The dates of the first line that begins with one, else the first in the entry: a company may have a year in its name."""
    return _found(F.coalesce(F.get(F.filter(_lines(entry), _dated), 0), entry), DATE)


def _bare(line: Column) -> Column:
    return F.regexp_replace(strip(line), r"^[-*]+|[-*]+$", "")


def school(entry: Column) -> Column:
    degree = F.coalesce(*[_found(entry, p) for p in P.RESUME_DEGREES])
    named = F.filter(F.slice(_lines(entry), 1, 3), lambda x: (x != "") & ~_dated(x) & F.coalesce(x != degree, F.lit(True)))
    major = _found(entry, r"(?i)(?:major|field|specialization|concentration)[:\s]+([^\n,]+)", 1)
    return F.struct(degree.alias("degree"), _dates(entry).alias("dates"), F.substring(F.get(named, 0), 1, 100).alias("institution"), major.alias("major"))


def job(entry: Column) -> Column:
    lines = _lines(entry)
    first, second = (F.when(~_dated(F.get(lines, n)), F.substring(F.get(lines, n), 1, 100)) for n in (0, 1))
    worded = F.lower(first).rlike("|".join(P.RESUME_POSITIONS))
    position, company = F.when(worded, first), F.when(~worded, first)
    said = F.array_join(F.filter(F.slice(lines, 3, 1 << 20), lambda x: x != ""), " ")
    return F.struct(
        F.coalesce(position, second).alias("position"), F.when(position.isNotNull(), F.coalesce(company, second)).otherwise(company).alias("company"),
        _dates(entry).alias("dates"), F.nullif(F.substring(said, 1, 500), F.lit("")).alias("description"),
    )


def language(line: Column) -> Column:
    level = F.regexp_extract(line, P.RESUME_LEVEL, 1)
    name = F.regexp_replace(strip(F.regexp_extract(line, rf"^(.*?){P.RESUME_LEVEL}", 1)), r"^[:\-]+|[:\-]+$", "")
    return F.when(level == "", F.struct(line.alias("language"), F.lit("Not specified").alias("level"))).otherwise(F.struct(name.alias("language"), F.initcap(level).alias("level")))


def resume_entries(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with education, experience, certifications, languages and location."""
    t, lines = F.col(text), F.split(text, "\n")
    body = {k: section_body(lines, P.RESUME_SECTIONS, k) for k in ("education", "experience", "certifications", "languages")}
    joined = lambda k: strip(F.array_join(body[k], "\n"))
    schools = F.filter(F.split(joined("education"), r"\n{2,}|\n(?=[A-Z])"), lambda e: strip(e) != "")
    schools = F.filter(F.transform(schools, lambda e: school(e)), lambda s: F.coalesce(s["degree"], s["dates"], s["institution"], s["major"]).isNotNull())
    jobs = F.filter(F.split(joined("experience"), r"\n{2,}"), lambda e: (strip(e) != "") & (F.length(e) >= 20))
    jobs = F.filter(F.transform(jobs, lambda e: job(e)), lambda j: j["company"].isNotNull() | j["position"].isNotNull())
    certificates = F.filter(F.transform(body["certifications"], lambda x: _bare(x)), lambda x: (F.length(x) > 5) & (F.length(x) < 100))
    spoken = F.filter(F.transform(body["languages"], lambda x: _bare(x)), lambda x: x != "")
    spoken = F.filter(F.transform(spoken, lambda x: language(x)), lambda x: x["language"] != "")
    places = [_found(F.substring(t, 1, 1500), p, 1) for p in P.RESUME_PLACES]
    fits = [F.when((F.length(p) > 3) & (F.length(p) < 100), p) for p in places]
    return docs.select(
        "*",
        F.slice(schools, 1, 5).alias("education"),
        F.slice(jobs, 1, 10).alias("experience"),
        F.slice(certificates, 1, 10).alias("certifications"),
        F.slice(spoken, 1, 10).alias("languages"),
        F.coalesce(*fits).alias("location"),
    )
