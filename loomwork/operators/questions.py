"""Questions and answers of a document: the cascade of explicit, bulleted, numbered and question-mark pairs.

A document's lines are one array of its row, and what depends on the lines before is a fold over that array; nothing is
shuffled until the kinds are compared per document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import patterns as P
from loomwork.functions.text import index_number, not_bullet, strip
from loomwork.operators.structure import explode_lines, qa_explicit, qa_numbered, started

PAIR = "array<struct<number:string,question:string,answer:string>>"
LEAST = 10
ASKING = "^(?:what|when|where|how|why|which|who|whose)"


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), strip)


def _paired(pairs: Column, number: Column, question: Column, answers: Column) -> Column:
    """``pairs`` with the open question, if it has one and an answer."""
    new = F.struct(number.alias("number"), question.alias("question"), F.array_join(answers, " ").alias("answer"))
    return F.when((question != "") & (F.size(answers) > 0), F.array_append(pairs, new)).otherwise(pairs)


def _start() -> list[Column]:
    none = F.lit(None).cast("string")
    return [F.array().cast(PAIR).alias("pairs"), none.alias("number"), F.lit("").alias("question"), F.array().cast("array<string>").alias("answers")]


def _kept(s: Column) -> list[Column]:
    return [s[c].alias(c) for c in ("pairs", "number", "question", "answers")]


def question_mark_pairs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, number, question, answer): a line of more than ten characters that ends in a question mark, and what
    follows it up to the next one or to two empty lines."""
    lines = F.transform(_lines(F.col(text)), lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def put(s: Column, line: Column, following: Column) -> Column:
        x = line["x"]
        asks = x.endswith("?") & (F.length(x) > LEAST)
        ends = (x == "") & (F.size(s["answers"]) > 0) & F.coalesce(following == "", F.lit(False))
        done = _paired(s["pairs"], s["number"], s["question"], s["answers"])
        none = F.array().cast("array<string>")
        begun = F.struct(done.alias("pairs"), s["number"].alias("number"), F.when(asks, x).otherwise("").alias("question"), none.alias("answers"))
        more = F.when((x != "") & (s["question"] != ""), F.array_append(s["answers"], x)).otherwise(s["answers"])
        open_ = F.struct(s["pairs"].alias("pairs"), s["number"].alias("number"), s["question"].alias("question"), more.alias("answers"))
        return F.when(asks | ends, begun).otherwise(open_)

    # Each line carries the one behind it.
    both = F.transform(lines, lambda x: F.struct(x["x"].alias("x"), F.get(F.transform(lines, lambda y: y["x"]), x["i"] + 1).alias("next")))
    found = F.aggregate(both, F.struct(*_start()), lambda s, x: put(s, x, x["next"]), lambda s: _paired(s["pairs"], s["number"], s["question"], s["answers"]))
    return docs.select(key, F.posexplode(found).alias("at", "p")).select(key, "at", "p.*")


#: A question mark further right than this, or on a line less far below the last, is none.
INDENT, LINE_HEIGHT = 10.0, 20.0


def bullet_pairs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, number, question, answer) of bulleted questions of plain texts: lines at one left edge and of one height."""
    lines = F.transform(_lines(F.col(text)), lambda x, i: F.struct(x.alias("text"), F.lit(0.0).alias("x0"), (i * LINE_HEIGHT).alias("top"), F.lit("").alias("layout")))
    return box_pairs(docs.select(key, lines.alias("boxes")), key, "boxes")


def box_pairs(docs: DataFrame, key: str, boxes: str) -> DataFrame:
    """(key, at, number, question, answer) of bulleted questions among a document's boxes (text, x0, top, layout), in order.

    The first question pattern that a box of the document has is the bullet. A box with it counts unless it

    * is further right than the box before it, once a question has begun, or than the bullets so far on average,
    * or, while none has begun, is the document's first, or on one line with the box before it and not left of it,
    * follows a box that ends in a colon,
    * or its number goes back; going back is allowed to a title, to a box that ends in a question mark and to one that begins
      with a question word.

    The question is what stands behind the box's first question mark, as known results have it; up to a second one, where
    there is one. It is a fold over the boxes of one document, whose state is the open question and the bullets' left edges.
    """

    def hit(x: Column) -> Column:
        return F.when(~not_bullet(x), F.least(*[F.when(started(x, p), i) for i, p in enumerate(P.QUESTION_PATTERNS)]))

    def by_set(n: Column, of) -> Column:
        return reduce(lambda out, i: out.when(n == i, of(P.QUESTION_PATTERNS[i])), range(1, len(P.QUESTION_PATTERNS)), F.when(n == 0, of(P.QUESTION_PATTERNS[0])))

    rows = docs.select(key, F.filter(boxes, lambda x: x["text"] != "").alias("boxes"))
    rows = rows.withColumn("set", F.array_min(F.transform("boxes", lambda x: hit(x["text"])))).filter("set is not null")

    def seen(box: Column, i: Column) -> Column:
        x, before = box["text"], F.get("boxes", i - 1)
        number = by_set(F.col("set"), lambda p: F.regexp_extract(x, f"^(?:{p})", 1))
        prefix = by_set(F.col("set"), lambda p: F.regexp_extract(x, f"^(?:{p})", 0))
        rest = by_set(F.col("set"), lambda p: F.regexp_extract(x, rf"^(?:{p}).*?(?:[?？]+|$)(.*)$", 2))
        asks = x.rlike("[?？]$") | (box["layout"] == "title") | F.lower(F.ltrim(x, prefix)).rlike(ASKING)
        after_colon = F.coalesce(before["text"].rlike("[:：]$"), F.lit(False))
        right = box["x0"] - F.coalesce(before["x0"], box["x0"])
        return F.struct(
            x.alias("x"), (by_set(F.col("set"), lambda p: started(x, p)) & ~after_colon).alias("marked"), not_bullet(x).alias("no_bullet"), number.alias("number"),
            index_number(number).alias("n"), strip(rest).alias("rest"), asks.alias("asks"), box["x0"].alias("x0"), right.alias("right"),
            ((right >= 0) & (box["top"] - F.coalesce(before["top"], box["top"]) < LINE_HEIGHT)).alias("beside"),
        )

    def put(s: Column, x: Column) -> Column:
        mean = F.when(s["bullets"] > 0, s["edges"] / s["bullets"]).otherwise(x["x0"])
        apart = F.when(s["begun"], x["right"] <= INDENT).otherwise(~x["beside"]) & (x["x0"] - mean <= INDENT)
        counts = x["marked"] & apart & ((s["last"] == 0) | (x["n"] >= s["last"]) | x["asks"])
        edges = [(s["edges"] + F.when(counts, x["x0"]).otherwise(0.0)).alias("edges"), (s["bullets"] + F.when(counts, 1).otherwise(0)).alias("bullets")]
        cut = F.regexp_extract(x["rest"], "^(.*?[?？])(.*)$", 1)
        tail = strip(F.regexp_extract(x["rest"], "^(.*?[?？])(.*)$", 2))
        number = F.when(x["n"] > 0, x["n"].cast("string")).otherwise(x["number"])
        first = F.when((cut != "") & (tail != ""), F.array(tail)).otherwise(F.array().cast("array<string>"))
        begun = F.struct(
            _paired(s["pairs"], s["number"], s["question"], s["answers"]).alias("pairs"), number.alias("number"), F.when(cut != "", cut).otherwise(x["rest"]).alias("question"),
            first.alias("answers"), x["n"].alias("last"), F.lit(True).alias("begun"), *edges,
        )
        more = F.when(s["question"] != "", F.array_append(s["answers"], x["x"])).otherwise(s["answers"])
        open_ = F.struct(*_kept(s)[:3], more.alias("answers"), s["last"].alias("last"), s["begun"].alias("begun"), *edges)
        return F.when(counts & ~x["no_bullet"], begun).otherwise(open_)

    start = F.struct(*_start(), F.lit(0).alias("last"), F.lit(False).alias("begun"), F.lit(0.0).alias("edges"), F.lit(0).alias("bullets"))
    found = F.aggregate(F.transform("boxes", seen), start, put, lambda s: _paired(s["pairs"], s["number"], s["question"], s["answers"]))
    return rows.select(key, F.posexplode(found).alias("at", "p")).select(key, "at", "p.*")


def qa_pairs(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, at, number, question, answer, form): the pairs of the first kind that finds any in a document, each question once."""
    none = F.lit(None).cast("string").alias("number")
    columns = [key, "at", "number", "question", "answer", "form"]
    kinds = [
        qa_explicit(docs, key, text).select(key, "at", none, "question", "answer", F.lit("explicit").alias("form")),
        bullet_pairs(docs, key, text).withColumn("form", F.lit("bullet")),
        qa_numbered(explode_lines(docs, key, text), key).withColumn("at", F.col("line_no")),
        question_mark_pairs(docs, key, text).withColumn("form", F.lit("question_mark")),
    ]
    ranked = [df.select(*columns, F.lit(n).alias("rank")) for n, df in enumerate(kinds)]
    every = reduce(DataFrame.unionByName, ranked)
    best = every.withColumn("best", F.min("rank").over(Window.partitionBy(key))).filter("rank = best")
    same = F.lower(F.regexp_replace(strip(F.col("question")), r"\s+", " "))
    first = Window.partitionBy(key, same).orderBy("at")
    return best.withColumn("n", F.row_number().over(first)).filter("n = 1").select(*columns)


def answer_lengths(pairs: DataFrame, key: str) -> DataFrame:
    """(key, pairs, average_answer_length): the mean in whole characters."""
    per = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.length("answer")).alias("chars"))
    return per.select(key, "pairs", F.floor(F.col("chars") / F.col("pairs")).alias("average_answer_length"))
