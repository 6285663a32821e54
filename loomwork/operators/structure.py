"""Structure of documents: lines with offsets, headings, definitions, tables, mail, questions, books, manuals, slides, papers, resumes.

Everything is column work on exploded lines or on the text of one row. Windows are partitioned by document, so a task holds
one document's lines; nothing is grouped over documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import patterns as P
from loomwork.functions.text import looks_like_data, looks_like_header, not_bullet, not_title, strip
from loomwork.operators.document_types import classify, confidences  # noqa: F401


def explode_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line without outer white space, offset of the raw line in the text)."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0))
    return lines.select(key, "line_no", strip(F.col("raw")).alias("line"), "raw", offset.alias("offset"))


def started(line: Column, pattern: str) -> Column:
    return line.rlike(f"^(?:{pattern})")


def any_of(line: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [started(line, p) for p in patterns])


def first_of(line: Column, patterns: tuple[str, ...]) -> Column:
    """Index of the first pattern that matches; null if none does."""
    out = F.when(started(line, patterns[0]), 0)
    for i, p in enumerate(patterns[1:], 1):
        out = out.when(started(line, p), i)
    return out


def groups_of(line: Column, patterns: tuple[str, ...], group: int) -> Column:
    """A group of the first pattern that matches."""
    out = F.when(line.rlike(patterns[0]), F.regexp_extract(line, patterns[0], group))
    for p in patterns[1:]:
        out = out.when(line.rlike(p), F.regexp_extract(line, p, group))
    return out


def bullet_set(lines: DataFrame, key: str) -> DataFrame:
    """(key, bullet_set): the set whose patterns start most lines; ties go to the first, -1 for none."""
    real = ~not_bullet(F.col("line"))
    counts = [F.count_if(real & any_of(F.col("line"), s)).alias(f"n{i}") for i, s in enumerate(P.BULLET_SETS)]
    return lines.groupBy(key).agg(*counts).select(key, _argmax([F.col(f"n{i}") for i in range(len(P.BULLET_SETS))]).alias("bullet_set"))


def _argmax(columns: list[Column]) -> Column:
    """Index of the greatest column, the first of equals; -1 if none is above zero."""
    best = F.greatest(*columns)
    out = F.when(best <= 0, -1)
    for i, c in enumerate(columns):
        out = out.when(c == best, i)
    return out


def question_set(lines: DataFrame, key: str) -> DataFrame:
    """(key, question_set): the first question pattern that any line has, -1 for none."""
    real = ~not_bullet(F.col("line"))
    hit = F.min(F.when(real, F.least(*[F.when(started(F.col("line"), p), i) for i, p in enumerate(P.QUESTION_PATTERNS)])))
    return lines.groupBy(key).agg(F.coalesce(hit, F.lit(-1)).alias("question_set"))


def heading_levels(lines: DataFrame, key: str, layout: Column | None = None) -> DataFrame:
    """``lines`` with bullet_set and level: the pattern's index, one more for other titles, two more for text."""
    layout = F.lit("") if layout is None else layout
    sets = lines.join(bullet_set(lines, key), key)
    out = F.when(F.col("bullet_set") < 0, 0)
    for i, s in enumerate(P.BULLET_SETS):
        level = F.coalesce(
            F.when(~not_bullet(F.col("line")), first_of(F.col("line"), s)),
            F.when(layout.rlike("title|head") & ~not_title(F.substring_index("line", "@", 1)), len(s)),
            F.lit(len(s) + 1),
        )
        out = out.when(F.col("bullet_set") == i, level)
    return sets.withColumn("level", out)


def common_level(levels: DataFrame, key: str) -> DataFrame:
    """(key, common_level): the most frequent level that isn't text; the text's if there is none. Ties: first seen."""
    size = F.element_at(F.array(*[F.lit(len(s)) for s in P.BULLET_SETS]), F.greatest(F.col("bullet_set") + 1, F.lit(1)))
    per = levels.withColumn("size", size).groupBy(key, "level").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("seen"), F.first("size").alias("size")
    )
    fit = F.when(F.col("level") <= F.col("size"), F.struct("n", -F.col("seen")))
    return per.groupBy(key).agg(F.coalesce(F.max_by("level", fit), F.first("size") + 1).alias("common_level"))


def headings(lines: DataFrame, key: str) -> DataFrame:
    """Numbered headings of legal texts with level name, number, title, place and the place where the next one starts."""
    sets = lines.join(bullet_set(lines, key), key).withColumn("set", F.when(F.col("bullet_set") < 0, 1).otherwise(F.col("bullet_set")))
    line = F.col("line")
    index, name, number, whole = F.lit(None), F.lit(None), F.lit(None), F.lit(None)
    for i, s in enumerate(P.BULLET_SETS):
        here = F.col("set") == i
        index = F.when(here, first_of(line, s)).otherwise(index)
        names = F.array(*[F.lit(n) for n in P.LEVEL_NAMES[i]])
        name = F.when(here, F.element_at(names, first_of(line, s) + 1)).otherwise(name)
        found = groups_of(line, tuple(f"^(?:{p})" for p in s), 0)
        group = groups_of(line, tuple(f"^(?:{p})" if "(" in p.replace(r"\(", "") else f"^({p})" for p in s), 1)
        whole, number = F.when(here, found).otherwise(whole), F.when(here, group).otherwise(number)
    marked = sets.withColumn("level_idx", index).filter(F.col("level_idx").isNotNull() & ~not_bullet(line) & (line != ""))
    title = F.regexp_replace(F.substr(line, F.length(whole) + 1, F.length(line)), r"^[\s.:\-]+", "")
    after = Window.partitionBy(key).orderBy("line_no")
    return marked.select(
        key, name.alias("level"), number.alias("number"), F.substring(strip(title), 1, 200).alias("title"), "line_no", "offset",
        F.lead("offset").over(after).alias("next_offset"),
    )


def definitions(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, term, definition) from the definitions sections: a flag carried from the last line that sets it."""
    mark = F.when(F.col("line").rlike(P.any_of(P.DEFINITIONS_START)), True).when(F.col("line").rlike(P.DEFINITIONS_END), False)
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = lines.withColumn("inside", F.last(mark, ignorenulls=True).over(so_far)).filter("inside")
    term = strip(groups_of(F.col("line"), P.DEFINITION_FORMS, 1))
    said = F.regexp_replace(strip(groups_of(F.col("line"), P.DEFINITION_FORMS, 2)), "[;.]$", "")
    found = inside.select(key, "line_no", term.alias("term"), F.substring(said, 1, 500).alias("definition"))
    return found.filter((F.length("term") > 2) & (F.length("definition") > 5))


def subtype(text: Column, kinds: tuple, other: str) -> Column:
    """The kind with most of its patterns in the first 5000 characters; ties go to the first."""
    sample = F.lower(F.substring(text, 1, 5000))
    scores = [reduce(lambda a, b: a + b, [sample.rlike(p).cast("int") for p in ps]) for _, ps in kinds]
    names = F.array(*[F.lit(n) for n, _ in kinds])
    best = _argmax(scores)
    return F.when(best < 0, other).otherwise(F.element_at(names, best + 1))


def table_cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|"), strip)


def tables(lines: DataFrame, key: str) -> DataFrame:
    """(key, table_no, row_no, cells, is_rule): runs of three and more pipe rows."""
    is_row = F.col("raw").rlike(r"^\s*\|.+\|")
    so_far = Window.partitionBy(key).orderBy("line_no")
    run = F.sum(F.when(is_row, 0).otherwise(1)).over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = lines.withColumn("is_row", is_row).withColumn("run", run).filter("is_row")
    long = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key, "run"))).filter("n >= 3")
    number = F.dense_rank().over(Window.partitionBy(key).orderBy("run"))
    row_no = F.row_number().over(Window.partitionBy(key, "run").orderBy("line_no")) - 1
    return long.select(
        key, number.alias("table_no"), row_no.alias("row_no"), table_cells(F.col("line")).alias("cells"), F.col("line").rlike(r"^\s*\|[-:\s|]+\|").alias("is_rule")
    )


def table_values(rows: DataFrame, key: str) -> DataFrame:
    """(key, table_no, row_no, column_no, header, value): data cells under their headers, those of several rows joined.

    Header rows end at the first rule; without one they are the leading rows that look like headers, five at most.
    """
    by_table = Window.partitionBy(key, "table_no")
    looks = F.size(F.filter("cells", looks_like_header)) >= F.size(F.filter("cells", lambda c: ~looks_like_header(c) & looks_like_data(c)))
    marked = rows.withColumn("rule_at", F.min(F.when(F.col("is_rule"), F.col("row_no"))).over(by_table)).withColumn(
        "plain_at", F.min(F.when(~looks | (F.col("row_no") >= 5), F.col("row_no"))).over(by_table)
    )
    heads = F.coalesce("rule_at", "plain_at", F.lit(0))
    cells = marked.withColumn("heads", heads).filter("not is_rule").select(
        key, "table_no", "row_no", "heads", F.posexplode("cells").alias("column_no", "value")
    )
    by_column = Window.partitionBy(key, "table_no", "column_no")
    part = F.when((F.col("row_no") < F.col("heads")) & (F.col("value") != "") & ((F.col("heads") == 1) | ~looks_like_data(F.col("value"))), F.struct("row_no", "value"))
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(part).over(by_column)), lambda x: x["value"]))
    header = F.when(F.size(names) > 0, F.array_join(names, " - ")).otherwise(F.concat(F.lit("Column_"), (F.col("column_no") + 1).cast("string")))
    return cells.withColumn("header", header).filter("row_no >= heads").drop("heads")


def table_blocks(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, table_no, rows): the tables of ``tables``, each with its rows (cells, is_rule) in one array.

    A text is cut where pipe rows begin and end, inside its own row: nothing is sorted or shuffled.
    """
    lines = F.transform(F.split(text, "\n"), lambda raw: F.struct(strip(raw).alias("line"), raw.rlike(r"^\s*\|.+\|").alias("row")))
    cut = docs.select(key, F.explode(F.array(lines)).alias("l"))
    edge = lambda at: F.coalesce(F.get("l.row", at), F.lit(False))
    place = F.transform("l", lambda x, i: F.when(x["row"] & ~edge(i - 1), -1 - i).otherwise(F.when(x["row"] & ~edge(i + 1), i)))
    # Of a run of three and more the first place is negative, the next one is its end.
    edges = cut.select(key, "l", F.explode(F.array(F.array_compact(place))).alias("e"))
    runs = F.transform("e", lambda x, i: F.when((x < 0) & (F.get("e", i + 1) + x >= 1), F.struct((-x).alias("first"), (F.get("e", i + 1) + x + 2).alias("n"))))
    found = edges.select(key, "l", F.posexplode(F.array_compact(runs)).alias("at", "run"))
    own = F.transform(F.slice("l", F.col("run.first"), F.col("run.n")), lambda x: F.struct(table_cells(x["line"]).alias("cells"), x["line"].rlike(r"^\s*\|[-:\s|]+\|").alias("is_rule")))
    return found.select(key, (F.col("at") + 1).alias("table_no"), own.alias("rows"))


def block_records(blocks: DataFrame, key: str) -> DataFrame:
    """(key, table_no, row_no, cells): a row for each data row of ``table_blocks``, its cells (column_no, header, value) as in ``table_values``."""
    cell = lambda r, c: F.get(r["cells"], c)
    looks = lambda r: F.size(F.filter(r["cells"], looks_like_header)) >= F.size(F.filter(r["cells"], lambda c: ~looks_like_header(c) & looks_like_data(c)))
    rule_at = F.array_position(F.col("rows.is_rule"), True)
    plain_at = F.array_position(F.transform(F.slice("rows", 1, 6), lambda r, i: ~looks(r) | (i >= 5)), True)
    marked = blocks.withColumn("heads", F.when(rule_at > 0, rule_at - 1).when(plain_at > 0, plain_at - 1).otherwise(0).cast("int"))
    said = lambda v: (v != "") & ((F.col("heads") == 1) | ~looks_like_data(v))
    names = lambda c: F.array_distinct(F.filter(F.transform(F.filter(F.slice("rows", F.lit(1), F.col("heads")), lambda r: ~r["is_rule"]), lambda r: cell(r, c)), said))
    wide = F.array_max(F.transform("rows", lambda r: F.size(r["cells"])))
    listed = F.transform(F.sequence(F.lit(0), wide - 1), lambda c: F.struct(c.alias("c"), names(c).alias("n")))
    header = F.transform(listed, lambda x: F.when(F.size(x["n"]) > 0, F.array_join(x["n"], " - ")).otherwise(F.concat(F.lit("Column_"), (x["c"] + 1).cast("string"))))
    rows = marked.withColumn("names", F.explode(F.array(header))).select(key, "table_no", "heads", "names", F.posexplode("rows").alias("row_no", "r"))
    cells = F.transform("r.cells", lambda v, i: F.struct(i.alias("column_no"), F.get("names", i).alias("header"), v.alias("value")))
    return rows.filter("row_no >= heads and not r.is_rule").select(key, "table_no", "row_no", cells.alias("cells"))


def block_values(blocks: DataFrame, key: str) -> DataFrame:
    """(key, table_no, row_no, column_no, header, value): ``table_values`` of ``table_blocks``."""
    return block_records(blocks, key).select(key, "table_no", "row_no", F.inline("cells"))


INTEGER, DECIMAL, BOOLEAN = r"^[+-]?[0-9]+$", r"^[+-]?[0-9.]{0,19}$", r"(?i)^(true|yes|\*|✓|✔|☑|✅|√|false|no|⍻|×)$"


def column_types(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, type): the kind most values have; ties go to int, float, text, datetime, bool in this order.

    Numbers that start with 0 aren't numbers; integers beyond 64 bits make the column float. Dates are ISO dates with or
    without a time.
    """
    v = F.col("value")
    kind = (
        F.when(v.rlike(INTEGER) & ~F.startswith(v, F.lit("0")), "int")
        .when(v.rlike(DECIMAL) & ~F.startswith(v, F.lit("0")), "float")
        .when(v.rlike(BOOLEAN), "bool")
        .when(F.try_to_timestamp(v).isNotNull(), "datetime")
        .otherwise("text")
    )
    whole = F.when(v.rlike(INTEGER) & ~F.startswith(v, F.lit("0")), v).try_cast("decimal(38,0)")
    huge = whole > F.lit("9223372036854775807").cast("decimal(38,0)")
    order = ["int", "float", "text", "datetime", "bool"]
    counts = values.filter(v.isNotNull()).groupBy(*keys).agg(*[F.count_if(kind == k).alias(f"_{k}") for k in order], F.coalesce(F.max(huge), F.lit(False)).alias("_huge"))
    best = _argmax([F.col(f"_{k}") for k in order])
    chosen = F.when(F.col("_huge"), "float").otherwise(F.element_at(F.array(*[F.lit(k) for k in order]), best + 1))
    return counts.select(*keys, chosen.alias("type"))


def column_statistics(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, min, max, avg, count) of numbers, after currency, percent, comma and space are taken out."""
    number = F.expr("try_cast(regexp_replace(value, '[,$%\\\\s]', '') AS double)")
    return values.withColumn("_n", number).filter("_n is not null").groupBy(*keys).agg(
        F.min("_n").alias("least"), F.max("_n").alias("most"), F.avg("_n").alias("mean"), F.count("_n").alias("n")
    )


def address(c: Column) -> tuple[Column, Column]:
    """(name, address) of ``Name <a@b>``, of a bare address, or of a bare name."""
    c = strip(c)
    full, bare = r"^(.+?)\s*<([^>]+)>$", r"^([\w.-]+@[\w.-]+\.\w+)$"
    name = F.when(c.rlike(full), F.regexp_replace(strip(F.regexp_extract(c, full, 1)), r'^"+|"+$', "")).when(c.rlike(bare), "").otherwise(c)
    return name, F.when(c.rlike(full), strip(F.regexp_extract(c, full, 2))).when(c.rlike(bare), c).otherwise("")


def mail_fields(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the fields of a mail: sender, recipients, subject, date, thread, body, signature, attachments."""
    t = F.col(text)
    head = F.substring_index(t, "\n\n", 1)

    def header(name: str) -> Column:
        return strip(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(head, F.lit(rf"(?im)^{name}:\s*(.+)$"), F.lit(1))), -1))

    def attached(pattern: str) -> Column:
        found = [F.regexp_extract_all(t, F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "filename"), (2, "size"))]
        return F.transform(F.arrays_zip(*found), lambda a: F.struct(strip(a["filename"]).alias("filename"), strip(a["size"]).alias("size")))

    body = F.when(F.instr(t, "\n\n") > 0, F.substr(t, F.instr(t, "\n\n") + 2, F.length(t))).otherwise(t)
    name, mail = address(header("From"))
    recipients = F.filter(F.split(F.concat_ws(",", header("To"), F.nullif(header("Cc"), F.lit(""))), r',\s*(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: x != "")
    date = F.regexp_replace(header("Date"), r"\s+\([A-Z]+\)$", "")
    # The day's name says nothing that the date doesn't.
    plain = F.regexp_replace(date, r"^[A-Z][a-z]{2}, ", "")
    when = F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in P.DATE_FORMATS if not f.startswith("EEE")])
    subject = header("Subject")
    quoted = F.regexp_count(t, F.lit(r"(?m)^>+"))
    replies = F.regexp_count(subject, F.lit(r"^(?:Re|RE|re):\s*"))
    is_reply = (replies > 0) | (header("In-Reply-To") != "") | (header("References") != "") | t.rlike(P.any_of(P.flagged("im", P.REPLY_MARKS)))
    lines = F.split(body, "\n")
    marks = F.transform(lines, lambda x: strip(x).rlike(P.any_of(P.flagged("i", P.SIGNATURES))))
    at = F.array_position(marks, True).cast("int")
    rest = F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines))
    return docs.select(
        "*",
        name.alias("sender_name"),
        mail.alias("sender_mail"),
        F.size(recipients).alias("recipients"),
        subject.alias("subject"),
        when.alias("sent_at"),
        is_reply.alias("is_reply"),
        (F.regexp_count(subject, F.lit(r"^(?:Fwd|FWD|Fw|FW):\s*")) > 0).alias("is_forward"),
        F.when(quoted > 5, F.greatest(replies, F.least(F.floor(quoted / 10), F.lit(5)))).otherwise(replies).cast("int").alias("depth"),
        F.when((at > 0) & (F.size(rest) <= 15), F.array_join(rest, "\n")).alias("signature"),
        F.filter(F.flatten(F.array(*[attached(p) for p in P.flagged("imd", P.ATTACHMENTS)])), lambda a: a["filename"] != "").alias("attachments"),
    )


def qa_explicit(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, question, answer) of Q: and A: paragraphs."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(P.QA_EXPLICIT), F.lit(1)).alias("q"), F.regexp_extract_all(text, F.lit(P.QA_EXPLICIT), F.lit(2)).alias("a")
    )
    found = docs.select(key, F.posexplode(pairs).alias("at", "x")).select(key, "at", strip(F.col("x.q")).alias("question"), strip(F.col("x.a")).alias("answer"))
    return found.filter((F.length("question") > 5) & (F.col("answer") != ""))


def qa_numbered(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, number, question, answer, form) of numbered questions, answered on the next lines or on their own."""
    line = F.col("line")
    question, inline, item = r"^(\d+)[.)]\s*(.+\?)\s*$", r"^(\d+)[.)]\s*(.+\?)\s+(.+)$", r"^\d+[.)]"
    kind = F.when(line.rlike(question), "question").when(line.rlike(inline), "inline").when(line.rlike(item), "item")
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = F.sum(F.when(F.col("kind").isNotNull(), 1).otherwise(0)).over(so_far)
    marked = lines.withColumn("kind", kind).withColumn("group", group).filter("group > 0")
    answer = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isNull() & (line != ""), F.struct("line_no", "line")))), lambda x: x["line"])
    per = marked.groupBy(key, "group").agg(F.min_by("kind", "line_no").alias("kind"), F.min_by("line", "line_no").alias("line"), F.min("line_no").alias("line_no"), answer.alias("answer"))
    own = per.filter("kind = 'question' and size(answer) > 0").select(
        key, "line_no", F.regexp_extract("line", question, 1).alias("number"), F.regexp_extract("line", question, 2).alias("question"), F.array_join("answer", " ").alias("answer"), F.lit("numbered").alias("form")
    )
    same = per.filter("kind = 'inline'").select(
        key, "line_no", F.regexp_extract("line", inline, 1).alias("number"), F.regexp_extract("line", inline, 2).alias("question"), F.regexp_extract("line", inline, 3).alias("answer"), F.lit("numbered_inline").alias("form")
    )
    return own.unionByName(same)


def qa_content(pairs: DataFrame, key: str, order: str) -> DataFrame:
    """(key, content, pairs): questions once each, by their first place, as ``Qn: ...``, ``An: ...``."""
    same = F.lower(F.regexp_replace(strip(F.col("question")), r"\s+", " "))
    first = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(key, same).orderBy(order))).filter("_n = 1").drop("_n")
    said = F.format_string("Q%1$s: %2$s\n\nA%1$s: %3$s", "number", "question", "answer")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), said.alias("s")))), lambda x: x["s"])
    return first.groupBy(key).agg(F.array_join(listed, "\n\n---\n\n").alias("content"), F.count(F.lit(1)).alias("pairs"))


def numbered_lines(lines: DataFrame, key: str, patterns: tuple[str, ...]) -> DataFrame:
    """(key, line_no, offset, number, title) of lines that one of the patterns matches."""
    line = F.col("line")
    found = lines.withColumn("number", groups_of(line, patterns, 1)).withColumn("title", strip(groups_of(line, patterns, 2)))
    return found.filter(F.col("number").isNotNull()).select(key, "line_no", "offset", "number", "title")


def book_contents(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, title, page) of the table of contents, 100 entries at most."""
    line = F.col("line")
    order = Window.partitionBy(key).orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = lines.filter("line_no < 300").withColumn("start", F.min(F.when(line.rlike(r"(?i)^(?:table\s+of\s+)?contents?$"), F.col("line_no"))).over(Window.partitionBy(key)))
    inside = first.filter("line_no > start")
    blank = F.max(F.when(line == "", F.col("line_no"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    stop = line.rlike(r"^(?:CHAPTER|Chapter|PART|Part)\s+1|^(?:INTRODUCTION|Introduction)$") | ((line == "") & (F.col("line_no") - F.coalesce(blank, F.lit(0)) > 5))
    open_ = inside.withColumn("over", F.max(stop).over(upto)).filter("not over and line <> ''")
    paged = r"^(.+?)[\s.]{3,}(\d+)$"
    title = F.when(line.rlike(paged), strip(F.regexp_extract(line, paged, 1))).otherwise(line)
    page = F.when(line.rlike(paged), F.regexp_extract(line, paged, 2).cast("int"))
    kept = open_.filter(line.rlike(paged) | (F.length(line) > 3)).withColumn("_n", F.row_number().over(order)).filter("_n <= 100")
    return kept.select(key, "line_no", title.alias("title"), page.alias("page"))


def procedures(lines: DataFrame, key: str) -> DataFrame:
    """(key, procedure, steps, first_line): a procedure begins at each step 1."""
    number = F.regexp_extract("line", P.STEP, 1).cast("int")
    steps = lines.filter(F.col("line").rlike(P.STEP)).withColumn("number", number)
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = steps.withColumn("procedure", F.sum(F.when(F.col("number") == 1, 1).otherwise(0)).over(so_far)).filter("procedure > 0")
    return grouped.groupBy(key, "procedure").agg(F.count(F.lit(1)).alias("steps"), F.min("line_no").alias("first_line"))


def callouts(lines: DataFrame, key: str) -> DataFrame:
    line = F.col("line")
    kind = F.when(F.instr(F.lower(line), P.CALLOUT_KINDS[0][0]) > 0, P.CALLOUT_KINDS[0][1])
    for word, name in P.CALLOUT_KINDS[1:]:
        kind = kind.when(F.instr(F.lower(line), word) > 0, name)
    said = groups_of(line, P.CALLOUTS, 1)
    return lines.withColumn("said", said).filter(F.col("said").isNotNull()).select(key, "line_no", kind.otherwise("note").alias("kind"), "said")


def requirements(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, item) of the first requirements section, 20 at most."""
    line = F.col("line")
    start = F.min(F.when(line.rlike(P.any_of(P.flagged("i", P.REQUIREMENTS_START))), F.col("line_no"))).over(Window.partitionBy(key))
    inside = lines.withColumn("start", start).filter("line_no > start")
    stop = F.min(F.when(line.rlike(P.any_of(P.flagged("i", P.REQUIREMENTS_END))), F.col("line_no"))).over(Window.partitionBy(key))
    item = r"^(?:[•\-\*]|\d+[.)])\s+(.+)$"
    kept = inside.withColumn("stop", stop).filter((F.col("stop").isNull() | (F.col("line_no") < F.col("stop"))) & line.rlike(item))
    ranked = kept.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("line_no"))).filter("_n <= 20")
    return ranked.select(key, "line_no", F.regexp_extract("line", item, 1).alias("item"))


def manual_sections(lines: DataFrame, key: str) -> DataFrame:
    """(key, family, line_no, title, offset): a line may open a section of several families."""
    families = F.array(*[F.when(F.col("line").rlike(P.any_of(p)), F.lit(f)) for f, p in P.MANUAL_SECTIONS.items()])
    found = lines.withColumn("family", F.explode(F.array_compact(families)))
    return found.select(key, "family", "line_no", F.col("line").alias("title"), "offset")


def manual_type(sections: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, manual_type): additive scores of the section families and of words in the text, the first greatest."""
    per = sections.groupBy(key).agg(F.collect_set("family").alias("f"))
    joined = docs.select(key, F.lower(F.substring(text, 1, 5000)).alias("s")).join(per, key, "left").withColumn("f", F.coalesce("f", F.array().cast("array<string>")))
    has = lambda f, x: F.when(F.array_contains("f", f), x).otherwise(0)
    says = lambda x, *words: F.when(reduce(lambda a, b: a & b, [F.instr("s", w) > 0 for w in words]), x).otherwise(0)
    scores = {
        "installation_guide": has("installation", 3) + has("configuration", 1) + F.when(F.array_contains("f", "installation") & (F.instr("s", "install") > 0), 1).otherwise(0),
        "user_guide": has("configuration", 2) + has("usage", 3) + has("troubleshooting", 1) + has("examples", 1),
        "api_reference": has("reference", 3) + has("examples", 1) + says(2, "api", "endpoint"),
        "troubleshooting_guide": has("troubleshooting", 3),
        "quick_start": has("installation", 1) + says(2, "quick start"),
    }
    best = F.greatest(_argmax(list(scores.values())), F.lit(0))
    return joined.select(key, F.element_at(F.array(*[F.lit(k) for k in scores]), best + 1).alias("manual_type"))


def code_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, language, code) of fenced blocks and of command lines, 50 at most of a document."""
    fence = r"```(\w*)\n([\s\S]*?)```"
    fenced = F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(fence), F.lit(1)).alias("l"), F.regexp_extract_all(text, F.lit(fence), F.lit(2)).alias("c")),
        lambda x: F.struct(F.when(x["l"] == "", "text").otherwise(x["l"]).alias("language"), strip(x["c"]).alias("code")),
    )
    commands = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*\$[ \t]+(\S.*)$"), F.lit(1)), lambda x: F.struct(F.lit("bash").alias("language"), strip(x).alias("code")))
    return docs.select(key, F.explode(F.slice(F.concat(fenced, commands), 1, 50)).alias("x")).select(key, "x.*")


def slides(lines: DataFrame, key: str) -> DataFrame:
    """(key, slide, number, title, bullets, notes): slides between boundary lines.

    A slide's number is the one its boundary names, else one more than the last: the count of unnamed boundaries since the
    last named one is added to that one's number.
    """
    line = F.col("line")
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    breaks, notes = P.flagged("i", P.SLIDE_BREAKS), P.flagged("i", P.SLIDE_NOTES)
    numbered = tuple(p for p in breaks if "(\\d+)" in p)
    named = F.nullif(groups_of(line, numbered, 1).cast("int"), F.lit(0))
    marked = lines.withColumn("edge", line.rlike(P.any_of(breaks))).withColumn("named", F.when(F.col("edge"), named))
    implicit = F.when((F.col("line_no") == 0) & ~F.col("edge"), 1).otherwise(0)
    marked = marked.withColumn("slide", F.sum(F.when(F.col("edge"), 1).otherwise(implicit)).over(order)).withColumn("base", F.last("named", ignorenulls=True).over(order))
    marked = marked.withColumn("base_slide", F.last(F.when(F.col("named").isNotNull(), F.col("slide")), ignorenulls=True).over(order))
    body = ~F.col("edge")
    return marked.groupBy(key, "slide").agg(
        F.coalesce(F.first("base") + F.first("slide") - F.first("base_slide"), F.first("slide")).cast("int").alias("number"),
        F.min_by(strip(groups_of(line, P.SLIDE_TITLES, 1)), F.when(body & line.rlike(P.any_of(P.SLIDE_TITLES)), F.col("line_no"))).alias("title"),
        F.count_if(body & line.rlike(P.any_of(P.SLIDE_BULLETS))).alias("bullets"),
        F.count_if(body & line.rlike(P.any_of(notes))).alias("notes"),
    )


def section_body(lines: Column, patterns: dict[str, str], name: str) -> Column:
    """Lines of an array below the first header of a section, up to the next header of another one."""
    others = "|".join(f"(?:{p})" for k, p in patterns.items() if k != name)
    at = F.array_position(F.transform(lines, lambda x: strip(x).rlike(patterns[name])), True).cast("int")
    rest = F.when(at > 0, F.slice(lines, at + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    stop = F.array_position(F.transform(rest, lambda x: strip(x).rlike(others)), True).cast("int")
    return F.when(stop > 0, F.slice(rest, 1, stop - 1)).otherwise(rest)


def resume_fields(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with contact, name, skills (sorted), degrees, sections and the confidence of a regular-expression reading."""
    t, lines = F.col(text), F.split(text, "\n")
    empty = F.lit("")
    mail, phone = F.nullif(F.regexp_extract(t, P.RESUME_EMAIL, 0), empty), F.nullif(F.regexp_extract(t, P.RESUME_PHONE, 0), empty)
    phone = F.when(F.length(F.regexp_replace(phone, r"\D", "")) >= 7, strip(phone))
    plain = F.filter(F.transform(F.slice(lines, 1, 5), strip), lambda x: x.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}$") & ~F.lower(x).rlike("resume|cv|curriculum") & (F.length(x) <= 50))
    named = F.filter(F.slice(lines, 1, 10), lambda x: x.rlike(r"(?i)^name\s*[:\-]\s*\S"))
    name = F.coalesce(strip(F.regexp_replace(F.get(named, 0), r"(?i)^name\s*[:\-]?\s*", "")), F.get(plain, 0))
    body = {k: section_body(lines, P.RESUME_SECTIONS, k) for k in ("education", "experience", "skills", "languages", "certifications")}
    items = F.transform(F.split(F.array_join(body["skills"], "\n"), r"[,\n|/]|\s{2,}"), lambda x: F.regexp_replace(strip(x), r"^[-*]+|[-*]+$", ""))
    skill = F.array_sort(F.array_distinct(F.filter(items, lambda x: (F.length(x) > 2) & (F.length(x) < 50) & ~x.rlike("(?i)^(beginner|intermediate|advanced|expert|proficient)"))))
    degree = lambda x: F.coalesce(*[F.nullif(strip(F.regexp_extract(x, p, 0)), empty) for p in P.RESUME_DEGREES])
    degrees = F.array_compact(F.transform(body["education"], lambda x: degree(x)))
    found = (name.isNotNull().cast("int") + mail.isNotNull().cast("int") + (F.size(degrees) > 0).cast("int")
             + (F.size(F.filter(body["experience"], lambda x: strip(x) != "")) > 0).cast("int") + (F.size(skill) > 0).cast("int"))
    present = F.array_compact(F.array(*[F.when(t.rlike("(?m)" + p), F.lit(k)) for k, p in P.RESUME_SECTIONS.items()]))
    return docs.select(
        "*",
        name.alias("name"),
        mail.alias("mail"),
        phone.alias("phone"),
        F.slice(skill, 1, 30).alias("skills"),
        degrees.alias("degrees"),
        F.array_sort(present).alias("sections"),
        F.round(F.least(F.lit(0.95), 0.5 + found * 0.1), 2).alias("confidence"),
    )


def degree_rank(c: Column) -> Column:
    out = F.when(F.instr(F.lower(c), P.DEGREE_RANK[0][0]) > 0, P.DEGREE_RANK[0][1])
    for word, rank in P.DEGREE_RANK[1:]:
        out = out.when(F.instr(F.lower(c), word) > 0, rank)
    return out.otherwise(0)


def paper_fields(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, authors, abstract, keywords, references, citations) of an academic text."""
    lines = F.transform(F.split(text, "\n"), strip)
    skip = r"(?i)^\d+$|^(?:arxiv|doi|issn|isbn)|^(?:submitted|accepted|published|received)|^(?:volume|issue|pages?)|^[A-Z]{2,}\s*\d+"
    long = lambda x: (F.size(F.split(x, r"\s+")) >= 3) & (F.length(x) > 20)
    title = F.get(F.filter(F.slice(lines, 1, 20), lambda x: long(x) & ~x.rlike(skip)), 0)
    cut = lambda array, pattern: F.array_position(F.transform(array, lambda x: x.rlike(pattern)), True).cast("int")
    upto = lambda array, pattern: F.when(cut(array, pattern) > 0, F.slice(array, 1, cut(array, pattern) - 1)).otherwise(array)
    after = lambda array, pattern: F.when(cut(array, pattern) > 0, F.slice(array, cut(array, pattern) + 1, F.size(array))).otherwise(F.array().cast("array<string>"))
    first50 = F.slice(lines, 1, 50)
    start = F.array_position(F.transform(first50, long), True).cast("int")
    region = upto(F.slice(first50, start + 1, F.size(first50)), r"(?i)^(?:abstract|introduction|keywords)")
    usable = F.filter(region, lambda x: (x != "") & (F.instr(x, "@") == 0) & ~x.rlike(r"^\d"))
    several = F.flatten(F.transform(usable, lambda x: F.when(x.rlike(r",\s*|\s+and\s+") & (F.length(x) < 200), F.regexp_extract_all(x, F.lit(r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"), F.lit(1))).when(x.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z]\.?\s*)*[A-Z][a-z]+$"), F.array(x)).otherwise(F.array().cast("array<string>"))))
    abstract = upto(after(F.slice(lines, 1, 100), r"(?i)^(?:\d+\.?\s*)?abstract\s*[:\-]?\s*$"), r"(?i)^(?:\d+\.?\s*)?(?:introduction|keywords?|index\s+terms?)")
    keyword_line = F.get(F.filter(F.slice(lines, 1, 100), lambda x: x.rlike(r"(?i)^(?:keywords?|key\s*words?|index\s+terms?)\s*[:\-]?\s*(.+)$")), 0)
    keywords = F.filter(F.transform(F.split(F.regexp_extract(keyword_line, r"(?i)^(?:keywords?|key\s*words?|index\s+terms?)\s*[:\-]?\s*(.+)$", 1), "[;,·•]"), strip), lambda x: x != "")
    refs = F.filter(upto(after(lines, r"(?i)^(?:\d+\.?\s*)?(?:references?|bibliography)\s*$"), r"^(?:APPENDIX|Appendix)"), lambda x: x.rlike(P.REFERENCE_ITEM))
    cites = F.regexp_count(text, F.lit(P.CITATIONS[0])) + F.regexp_count(text, F.lit(P.CITATIONS[1]))
    return docs.select(
        key,
        F.regexp_replace(title, "[.;,]+$", "").alias("title"),
        F.array_join(F.slice(F.array_distinct(several), 1, 10), "; ").alias("authors"),
        F.array_join(F.filter(abstract, lambda x: x != ""), " ").alias("abstract"),
        F.array_join(F.slice(keywords, 1, 15), "; ").alias("keywords"),
        F.size(F.slice(refs, 1, 100)).alias("refs"),
        cites.cast("int").alias("citations"),
    )


def title_paths(levels: DataFrame, key: str, depth: int = 3) -> DataFrame:
    """(key, path, body): text lines under the titles of the first ``depth`` levels above them.

    The title of each level is carried forward until one of a higher level comes.
    """
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    titled = levels.withColumn("is_title", F.col("level") < depth)
    above = []
    for d in range(depth):
        at = F.last(F.when(F.col("level") == d, F.struct("line_no", "line")), ignorenulls=True).over(order)
        higher = F.max(F.when(F.col("level") < d, F.col("line_no"))).over(order)
        above.append(F.when(at["line_no"] > F.coalesce(higher, F.lit(-1)), at["line"]))
    pathed = titled.withColumn("path", F.concat_ws(" > ", *above)).withColumn("block", F.sum(F.col("is_title").cast("int")).over(order))
    text = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_title") & (F.col("line") != ""), F.struct("line_no", "line")))), lambda x: x["line"])
    per = pathed.groupBy(key, "block").agg(F.max_by("path", "line_no").alias("path"), F.array_join(text, "\n").alias("body"))
    return per.filter("body <> ''").select(key, "block", "path", "body")


def _sums_before() -> Callable:
    """Of each list the sums before its elements; not marked as deterministic, so that no later step runs it a second time."""

    def run(sizes: pa.Array) -> pa.Array:
        return pa.array([[*accumulate(x[:-1], initial=0)] if x else [] for x in sizes.to_pylist()], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<bigint>").asNondeterministic()


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section, number, name, line_no, offset, next_offset, body) of papers.

    A section begins at a line that one of the ordered patterns matches: with a number any of their names, without one only
    those of the last patterns. It holds the lines up to the next section; lines before the first belong to none. Texts are cut
    inside their own row.
    """
    patterns = P.flagged("i", P.ACADEMIC_SECTIONS)
    numbered = tuple(p for p in patterns if "(\\d+" in p)
    plain = tuple(p for p in patterns if p not in numbered)

    def looked(x: Column) -> Column:
        line = x["line"]
        number = F.coalesce(strip(groups_of(line, numbered, 1)), F.lit(""))
        name = strip(F.coalesce(groups_of(line, numbered, 2), groups_of(line, plain, 1)))
        # Most lines match no pattern and are not held against each of them.
        head = F.when(line.rlike(P.any_of(patterns)), F.struct(number.alias("number"), name.alias("name")))
        return F.struct(line.alias("line"), x["n"].alias("n"), F.when(head["name"].isNotNull(), head).alias("head"))

    raw = F.transform(F.split(text, "\n"), lambda x: F.struct(strip(x).alias("line"), (F.length(x) + 1).alias("n")))
    rows = docs.select(key, F.transform(raw, looked).alias("l"))
    at = F.transform("l", lambda x, i: F.when(x["head"].isNotNull(), i))
    rows = rows.select(key, "l", F.filter(at, lambda i: i.isNotNull()).alias("at"))
    # The characters of what lies before the first section, then of each section.
    ends = F.concat(F.slice("at", 1, F.size("at")), F.array(F.size("l")))
    rows = rows.select(key, "l", F.arrays_zip(F.concat(F.array(F.lit(0)), "at").alias("first"), ends.alias("end")).alias("s"))
    rows = rows.select(key, F.transform("s", lambda s: F.struct(s["first"].alias("first"), F.slice("l", s["first"] + 1, s["end"] - s["first"]).alias("l"))).alias("s"))
    sizes = F.transform("s", lambda s: F.aggregate(s["l"], F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    rows = rows.select(key, "s", _sums_before()(sizes).alias("begins"))
    body = lambda l: F.array_join(F.transform(F.filter(l, lambda x: x["head"].isNull() & (x["line"] != "")), lambda x: x["line"]), "\n")
    shown = F.transform(F.slice("s", 2, F.size("s")), lambda s, i: F.struct(
        (i + 1).cast("long").alias("section"), s["l"][0]["head"]["number"].alias("number"), s["l"][0]["head"]["name"].alias("name"), s["first"].alias("line_no"),
        F.get("begins", i + 1).alias("offset"), body(s["l"]).alias("body"), F.get("begins", i + 2).alias("next_offset"),
    ))
    return rows.select(key, F.inline(shown))
