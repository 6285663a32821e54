"""Registered queries that cut legal texts, papers and books by their headings.

Texts are rendered from the lines of orders, an order a document, so that headings of all levels come in any order and number;
the SQL gets levels and names from those rows and finds the headings above a line in ways of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import patterns as P
from loomwork.operators import structure as S
from loomwork.operators.json_split import MOST, json_nodes, split_json
from loomwork.operators.merging import hierarchical_merge, text_levels, tree_merge
from loomwork.session import staged, table

#: Chunks of a document that the processors keep.
MOST_CHUNKS = 100


def _texts(spark: SparkSession, sf_dir: str, heading: str, first: str) -> DataFrame:
    """(l_orderkey, text): for each line of an order a heading (or null) and up to two lines of text below it."""
    body = "transform(slice(array(1, 2), 1, cast(l_quantity as int) % 3), i -> concat('finding ', l_partkey, ' number ', i))"
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"),
        F.expr(f"concat_ws('\n', {heading}, {body})").alias("lines"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o", "lines"))), lambda x: x["lines"])
    texts = rows.groupBy("l_orderkey").agg(F.filter(listed, lambda x: x != "").alias("l"))
    return texts.select("l_orderkey", F.array_join(F.concat(F.expr(f"if({first}, array('preamble'), array())"), "l"), "\n").alias("text"))


LEGAL = (
    "element_at(array(concat('PART ', element_at(array('ONE','TWO','THREE','FOUR','FIVE'), cast(l_suppkey % 5 + 1 as int))), "
    "concat('Chapter ', l_linenumber), concat('Section ', l_linenumber, '. Scope'), concat('Article ', l_partkey % 90, ' of it'), "
    "'SECTION on returns'), cast(l_partkey % 5 + 1 as int))"
)
PAPER = (
    "element_at(array(concat(l_linenumber, '.1.', l_suppkey % 9, ' Detail'), concat(l_linenumber, '.', l_suppkey % 9, ' Part of it'), "
    "concat(l_linenumber, '. ', element_at(array('RESULTS','Background','Related  work','conclusion'), cast(l_partkey % 4 + 1 as int))), "
    "element_at(array('Abstract','introduction','METHODS','Results','Discussion','Conclusion','References','Background','Summary'), cast(l_partkey % 9 + 1 as int)), "
    "null), cast(l_suppkey % 5 + 1 as int))"
)
BOOK = (
    "element_at(array('# Part of orders', concat('CHAPTER ', l_linenumber, ': Trade'), concat('## Section ', l_linenumber), concat('### Detail ', l_suppkey), null), "
    "cast(l_partkey % 5 + 1 as int))"
)


def _shown(chunks: DataFrame, *columns: str) -> DataFrame:
    return chunks.select("l_orderkey", F.col("at").cast("long").alias("at"), *columns, F.array_join("lines", "\n").alias("chunk"))


def _levels(spark: SparkSession, sf_dir: str, heading: str, titles: tuple[str, ...] = ()) -> DataFrame:
    layout = (lambda line: F.when(line.rlike(P.any_of(titles)), "title").otherwise("")) if titles else None
    return text_levels(_texts(spark, sf_dir, heading, "l_orderkey % 2 = 0"), "l_orderkey", layout=layout)


def legal_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal texts as trees of part, chapter, section and article, three levels deep."""
    levels = _levels(spark, sf_dir, LEGAL, P.LEGAL_TITLES)
    return _shown(tree_merge(levels, "l_orderkey", depth=3, most=MOST_CHUNKS))


def paper_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers as trees of numbered headings, two levels deep."""
    levels = _levels(spark, sf_dir, PAPER)
    return _shown(tree_merge(levels, "l_orderkey", depth=2, most=MOST_CHUNKS))


def paper_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of papers with their number, place and body."""
    found = S.sections(_texts(spark, sf_dir, PAPER, "l_orderkey % 2 = 0"), "l_orderkey")
    return found.select("l_orderkey", "section", "number", "name", "line_no", "offset", "next_offset", "body")


def book_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books by the hierarchical merge, three levels from the text up; part and chapter lines are titles."""
    titles = P.flagged("i", P.BOOK_PARTS + P.BOOK_CHAPTERS)
    levels = _levels(spark, sf_dir, BOOK, titles)
    return _shown(hierarchical_merge(levels, "l_orderkey", depth=3, most=MOST_CHUNKS))


def _event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, text): a JSON document for each user: days, in each the list of its events with their properties."""
    event = F.concat(
        F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "type": "'), F.col("event_type"), F.lit('", "props": '), F.col("props"), F.lit("}")
    )
    rows = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", event.alias("e"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "e"))), lambda x: x["e"])
    days = rows.groupBy("user_id", "day").agg(F.concat(F.lit('"'), F.col("day"), F.lit('": ['), F.array_join(listed, ", "), F.lit("]")).alias("d"))
    whole = F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "days": {'), F.array_join(F.array_sort(F.collect_list("d")), ", "), F.lit("}}"))
    return days.groupBy("user_id").agg(whole.alias("text"))


def json_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of users' documents, read again: every value with its path in the whole document, and whether its chunk keeps the bound."""
    chunks = staged(split_json(_event_json(spark, sf_dir), "user_id", "text"), "json-chunks")
    asked = chunks.withColumn("at", F.struct("user_id", (F.col("n_chars") <= MOST).alias("fits")))
    leaves = json_nodes(asked, "at", "content").filter("is_leaf")
    path = F.array_join(F.transform("path", lambda k: F.substr(k, F.lit(2), F.length(k) - 2)), "/")
    return leaves.select("at.user_id", path.alias("path"), "value", "at.fits")


QUERIES = {
    "s4_json_split": json_split,
    "d1e_legal_tree": legal_tree,
    "d2c_paper_tree": paper_tree,
    "d2b_paper_sections": paper_sections,
    "d5_book_hierarchy": book_hierarchy,
}


def _rows_sql(heading: str, level: str, first: str) -> str:
    """(l_orderkey, place, level, line): all lines in order; ``level`` of a heading, ``first`` of text."""
    return f"""
    li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem),
    parts AS (
        SELECT DISTINCT l_orderkey, 0 AS r, 0 AS s, {first} AS level, 'preamble' AS line FROM li WHERE l_orderkey % 2 = 0
        UNION ALL SELECT l_orderkey, r, 0, {level}, {heading} FROM li
        UNION ALL SELECT l_orderkey, r, s, {first}, 'finding ' || l_partkey || ' number ' || s FROM li, (VALUES (1), (2)) AS t(s) WHERE s <= l_quantity::INT % 3),
    lines AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY r, s) - 1 AS place, level, line FROM parts WHERE line IS NOT NULL)"""


_LEGAL_SQL = _rows_sql(
    "['PART ' || ['ONE','TWO','THREE','FOUR','FIVE'][l_suppkey % 5 + 1], 'Chapter ' || l_linenumber, 'Section ' || l_linenumber || '. Scope', "
    "'Article ' || l_partkey % 90 || ' of it', 'SECTION on returns'][l_partkey % 5 + 1]",
    "l_partkey % 5",
    "5",
)
_PAPER_NAME = "['RESULTS','Background','Related  work','conclusion'][l_partkey % 4 + 1]"
_PLAIN_NAME = "['Abstract','introduction','METHODS','Results','Discussion','Conclusion','References','Background','Summary'][l_partkey % 9 + 1]"
_PAPER_SQL = _rows_sql(
    f"[l_linenumber || '.1.' || l_suppkey % 9 || ' Detail', l_linenumber || '.' || l_suppkey % 9 || ' Part of it', l_linenumber || '. ' || {_PAPER_NAME}, {_PLAIN_NAME}, NULL][l_suppkey % 5 + 1]",
    "[1, 2, 3, 5, NULL][l_suppkey % 5 + 1]",
    "5",
)
_BOOK_SQL = _rows_sql(
    "['# Part of orders', 'CHAPTER ' || l_linenumber || ': Trade', '## Section ' || l_linenumber, '### Detail ' || l_suppkey, NULL][l_partkey % 5 + 1]",
    "[0, 6, 1, 2, NULL][l_partkey % 5 + 1]",
    "7",
)


def _tree_sql(rows: str, patterns: int, text: int, depth: int) -> str:
    return f"""
    WITH {rows},
    known AS (SELECT * FROM lines WHERE l_orderkey IN (SELECT l_orderkey FROM lines WHERE level < {patterns})),
    seen AS (SELECT l_orderkey, list_sort(list_distinct(list(level))) AS s FROM known GROUP BY l_orderkey),
    wanted AS (SELECT l_orderkey, s, coalesce(s[{depth}], s[-1]) AS w FROM seen),
    target AS (SELECT l_orderkey, CASE WHEN w = {text} AND len(s) > 1 THEN s[-2] ELSE w END AS t FROM wanted),
    heads AS (SELECT k.* FROM known k JOIN target USING (l_orderkey) WHERE level <= t),
    spans AS (SELECT l_orderkey, place, level, lead(place) OVER w AS to_place, lead(level) OVER w AS next_level FROM heads WINDOW w AS (PARTITION BY l_orderkey ORDER BY place)),
    texts AS (
        SELECT s.l_orderkey, s.place, any_value(s.level) AS level, any_value(s.next_level) AS next_level, string_agg(k.line, chr(10) ORDER BY k.place) AS body
        FROM spans s JOIN known k ON k.l_orderkey = s.l_orderkey AND k.place >= s.place AND (s.to_place IS NULL OR k.place < s.to_place) GROUP BY s.l_orderkey, s.place),
    above AS (
        SELECT leaf.l_orderkey, leaf.place, a.place AS a_place, a.body FROM texts leaf JOIN texts a ON a.l_orderkey = leaf.l_orderkey AND
            (a.place = leaf.place OR (a.place < leaf.place AND a.level < leaf.level AND NOT EXISTS (
                SELECT 1 FROM heads b WHERE b.l_orderkey = leaf.l_orderkey AND b.place > a.place AND b.place < leaf.place AND b.level <= a.level)))
        WHERE leaf.next_level IS NULL OR leaf.next_level <= leaf.level),
    chunks AS (
        SELECT l_orderkey, place, string_agg(body, chr(10) ORDER BY a_place) AS chunk FROM above GROUP BY l_orderkey, place
        UNION ALL
        SELECT k.l_orderkey, -1, string_agg(line, chr(10) ORDER BY k.place) FROM known k
        WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.l_orderkey = k.l_orderkey AND h.place <= k.place) GROUP BY k.l_orderkey)
    SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) - 1 AS "at", chunk FROM chunks QUALIFY "at" < {MOST_CHUNKS}"""


_HIERARCHY_SQL = f"""
    WITH {_BOOK_SQL},
    known AS (SELECT * FROM lines WHERE l_orderkey IN (SELECT l_orderkey FROM lines WHERE level < 6)),
    -- Of each line, the last line before it of each higher level, from the level next to its own up.
    higher AS (
        SELECT k.l_orderkey, k.place, k.level, list(a.p ORDER BY a.level DESC) FILTER (a.p IS NOT NULL) AS h
        FROM known k LEFT JOIN LATERAL (
            SELECT b.level, max(b.place) AS p FROM known b WHERE b.l_orderkey = k.l_orderkey AND b.place < k.place AND b.level < k.level GROUP BY b.level) a ON true
        GROUP BY k.l_orderkey, k.place, k.level),
    chains AS (
        SELECT l_orderkey, place, level, list_reduce(list_transform(coalesce(h, []), lambda x: [x]),
            lambda held, x: CASE WHEN x[1] > held[-1] THEN list_concat(held[1:len(held) - 1], x) ELSE list_concat(held, x) END, [place]) AS c FROM higher),
    first AS (SELECT * FROM chains WHERE level = 7),
    second AS (SELECT * FROM chains c WHERE level = 6 AND NOT EXISTS (SELECT 1 FROM first f WHERE f.l_orderkey = c.l_orderkey AND list_contains(f.c, c.place))),
    both_ AS (SELECT * FROM first UNION ALL SELECT * FROM second),
    third AS (SELECT * FROM chains c WHERE level = 5 AND NOT EXISTS (SELECT 1 FROM both_ f WHERE f.l_orderkey = c.l_orderkey AND list_contains(f.c, c.place))),
    every AS (SELECT * FROM both_ UNION ALL SELECT * FROM third),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY level DESC, place) - 1 AS "at" FROM every QUALIFY "at" < {MOST_CHUNKS}),
    links AS (SELECT l_orderkey, "at", unnest(c) AS place, generate_subscripts(c, 1) AS n FROM ranked)
    SELECT l_orderkey, "at", string_agg(line, chr(10) ORDER BY n DESC) AS chunk FROM links JOIN known USING (l_orderkey, place) GROUP BY l_orderkey, "at" """

ORACLES = {
    "s4_json_split": """
    WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1 AS i FROM events),
    p AS (SELECT *, 'days/' || day || '/' || i || '/' AS pre FROM e)
    SELECT DISTINCT user_id, 'user' AS path, user_id::VARCHAR AS value, true AS fits FROM events
    UNION ALL SELECT user_id, pre || 'event_id', event_id::VARCHAR, true FROM p
    UNION ALL SELECT user_id, pre || 'type', '"' || event_type || '"', true FROM p
    UNION ALL SELECT user_id, pre || 'props/' || k, json_extract(props, '$.' || k)::VARCHAR, true FROM (SELECT *, unnest(json_keys(props)) AS k FROM p)""",
    "d1e_legal_tree": _tree_sql(_LEGAL_SQL, 4, 5, 3),
    "d2c_paper_tree": _tree_sql(_PAPER_SQL, 4, 5, 2),
    "d2b_paper_sections": f"""
    WITH {_PAPER_SQL},
    placed AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY l_orderkey ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM lines),
    named AS (
        SELECT *, CASE WHEN level = 3 THEN line[4:] WHEN line IN ('Abstract','introduction','METHODS','Results','Discussion','Conclusion','References') THEN line END AS name,
               CASE WHEN level = 3 THEN line[1:2] ELSE '' END AS number FROM placed),
    cut AS (SELECT *, count(name) OVER (PARTITION BY l_orderkey ORDER BY place ROWS UNBOUNDED PRECEDING) AS section FROM named),
    per AS (
        SELECT l_orderkey, section, arg_min(number, place) AS number, arg_min(name, place) AS name, min(place) AS line_no, min(off) AS o,
               coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (name IS NULL), '') AS body FROM cut WHERE section > 0 GROUP BY l_orderkey, section)
    SELECT l_orderkey, section, number, name, line_no, o AS "offset", lead(o) OVER (PARTITION BY l_orderkey ORDER BY line_no) AS next_offset, body FROM per""",
    "d5_book_hierarchy": _HIERARCHY_SQL,
}
