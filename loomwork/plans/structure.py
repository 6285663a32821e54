"""Registered structure queries. Documents are rendered from relational rows; the SQL gets its answers from those rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import patterns as P
from loomwork.operators import questions as Q
from loomwork.operators import structure as S
from loomwork.operators.merging import hierarchical_merge, merge_levels
from loomwork.operators.resumes import resume_entries as resumes_of
from loomwork.session import spread, table


def _joined(df: DataFrame, key: str, order: str, line: F.Column) -> DataFrame:
    """(key, body): one text of each key's rendered rows, in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    return df.groupBy(key).agg(F.array_join(listed, "\n").alias("body"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "region")


def _legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = _joined(_nations(spark, sf_dir), "region", "n_nationkey", F.expr("concat('Article ', n_nationkey, ': ', n_name, '\\nThe party shall not be liable under this agreement.')"))
    terms = _joined(_nations(spark, sf_dir), "region", "n_nationkey", F.expr("concat('\"', n_name, '\" means the nation numbered ', n_nationkey, ';')")).withColumnRenamed("body", "terms")
    number = F.element_at(F.expr("array('ONE','TWO','THREE','FOUR','FIVE')"), F.col("region") + 1)
    text = F.concat(F.lit("PART "), number, F.lit("\n\nSection 1. Scope\n"), "body", F.lit("\nDEFINITIONS\n"), "terms", F.lit("\nSection 2. Rest\n'Late' means after the end"))
    return articles.join(terms, "region").select("region", text.alias("text"))


def legal_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.headings(S.explode_lines(_legal(spark, sf_dir), "region"), "region")
    return found.select("region", "level", "number", "title", "offset", "next_offset")


def legal_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.definitions(S.explode_lines(_legal(spark, sf_dir), "region"), "region").select("region", "term", "definition")


def legal_subtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legal(spark, sf_dir).select("region", S.subtype(F.col("text"), P.LEGAL_SUBTYPES, "other").alias("subtype"))


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("concat('## ', n_name, '\\nbody of ', lower(n_name), '\\nmore of it')")
    text = F.concat(F.lit("# Region "), F.col("region").cast("string"), F.lit("\nintro\n"), "body")
    return _joined(_nations(spark, sf_dir), "region", "n_nationkey", line).select("region", text.alias("text"))


def bullet_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _legal(spark, sf_dir).withColumn("region", F.col("region") + 100).unionByName(_outline(spark, sf_dir))
    lines = S.explode_lines(both, "region")
    levels = S.heading_levels(lines, "region")
    return S.bullet_set(lines, "region").join(S.common_level(levels, "region"), "region").join(S.question_set(lines, "region"), "region")


def merged_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal texts and outlines merged under their headings, three levels deep, 100 chunks at most."""
    both = _legal(spark, sf_dir).withColumn("region", F.col("region") + 100).unionByName(_outline(spark, sf_dir))
    found = hierarchical_merge(merge_levels(S.explode_lines(both, "region"), "region"), "region", depth=3, most=100)
    return found.select("region", "at", F.array_join("lines", "\n").alias("chunk"))


def title_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = S.heading_levels(S.explode_lines(_outline(spark, sf_dir), "region"), "region")
    return S.title_paths(levels, "region").select("region", "path", "body")


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(
        "concat('|', l_partkey, '|', cast(l_quantity as int), '| ', cast(cast(l_extendedprice as decimal(20,2)) as string), ' |', date_format(l_shipdate, 'yyyy-MM-dd'), '|', "
        "l_returnflag, '|', if(l_linenumber > 2, 'yes', 'no'), '|')"
    )
    rows = table(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    text = F.concat(F.lit("Order rows\n|part|qty|price|shipped|flag|late|\n|---|--:|---|---|---|---|\n"), "body", F.lit("\nafter | it\n"))
    return _joined(rows, "l_orderkey", "o", line).select("l_orderkey", text.alias("text"))


def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = S.block_values(S.table_blocks(_tables(spark, sf_dir), "l_orderkey"), "l_orderkey")
    types = S.column_types(values, ["l_orderkey", "header"])
    return types.groupBy("header", "type").agg(F.count(F.lit(1)).alias("tables"))


def table_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = S.block_values(S.table_blocks(_tables(spark, sf_dir), "l_orderkey"), "l_orderkey")
    stats = S.column_statistics(values.filter("header in ('qty', 'price')"), ["l_orderkey", "header"])
    return stats.select("l_orderkey", "header", "least", "most", F.round(F.col("mean") * F.col("n"), 2).alias("total"), "n")


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = S.block_records(S.table_blocks(_tables(spark, sf_dir), "l_orderkey"), "l_orderkey")
    row = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["header"], c["value"])))
    rows = records.select("l_orderkey", row.alias("m"))
    return rows.select("l_orderkey", F.col("m")["part"].cast("long").alias("part"), F.col("m")["price"].alias("price"), F.col("m")["shipped"].alias("shipped"))


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"))
    orders = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    text = F.expr(
        "concat('From: \"', c_name, '\" <c', c_custkey, '@mail.example.com>\\nTo: Shop <shop@example.com>, \"Last, First\" <x@example.com>', "
        "if(o_orderkey % 2 = 0, '\\nCc: boss@example.com', ''), '\\nSubject: ', if(o_orderkey % 3 = 0, 'Re: ', if(o_orderkey % 3 = 1, 'Fwd: ', '')), 'Order ', o_orderkey, "
        "'\\nDate: ', if(o_orderkey % 2 = 0, date_format(o_orderdate, 'EEE, dd MMM yyyy HH:mm:ss'), date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')), "
        "'\\n\\nHello,\\nprice ', o_totalprice, if(o_orderkey % 5 = 0, repeat('\\n> quoted', 25), ''), if(o_orderkey % 4 = 0, '\\nAttachment: bill.pdf (12 KB)', ''), "
        "if(o_orderkey % 7 = 0, concat('\\n- scan', o_custkey, '.PDF (3 KB) and\\nsee File: notes.txt'), ''), '\\nBest regards,\\n', c_name)"
    )
    return orders.select("o_orderkey", text.alias("text"))


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.mail_fields(_mails(spark, sf_dir), "text")
    return found.select("o_orderkey", "sender_name", "sender_mail", "recipients", "subject", F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss").alias("sent"),
                        "is_reply", "is_forward", "depth", "signature", F.array_join(F.transform("attachments", lambda a: F.concat_ws("|", a["filename"], a["size"])), ",").alias("attachments"))


def _explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(table(spark, sf_dir, "part"), "p_brand", "p_partkey", F.expr("concat('Q: What is ', p_name, '?\\nA: Costs ', p_retailprice, '\\nand size ', p_size)"))


def qa_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.qa_explicit(_explicit(spark, sf_dir), "p_brand", "body").select("p_brand", "at", "question", "answer")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("concat(p_partkey, if(p_size % 5 = 0, concat('. Is ', p_name, ' good? Yes it is.'), concat(') Is ', p_type, ' good?\\nNo.\\n\\nOr ', p_size)))")
    return _joined(table(spark, sf_dir, "part"), "p_brand", "p_partkey", line)


def qa_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.explode_lines(_numbered(spark, sf_dir), "p_brand", "body")
    return S.qa_numbered(lines, "p_brand").select("p_brand", "number", "question", "answer", "form")


def qa_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.qa_numbered(S.explode_lines(_numbered(spark, sf_dir), "p_brand", "body"), "p_brand")
    return S.qa_content(pairs, "p_brand", "line_no").select("p_brand", F.md5("content").alias("h"), "pairs")


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    toc = _joined(_nations(spark, sf_dir), "region", "n_nationkey", F.expr("concat(n_name, ' ..... ', n_nationkey + 1)")).withColumnRenamed("body", "toc")
    body = _joined(_nations(spark, sf_dir), "region", "n_nationkey", F.expr("concat('Chapter ', n_nationkey + 1, ': ', n_name, '\\nSection ', n_nationkey, '.1 More\\ntext')"))
    # Words in other cases than the known ones are no front or back matter.
    even = F.col("region") % 2 == 0
    contents, glossary = F.when(even, "TABLE OF CONTENTS").otherwise("Table of Contents"), F.when(even, "Glossary").otherwise("glossary")
    text = F.concat(F.lit("A long book title\n"), contents, F.lit("\n"), "toc", F.lit("\n\nPreface\nPart I. First\n"), "body", F.lit("\n"), glossary, F.lit("\nAppendix A"))
    return toc.join(body, "region").select("region", text.alias("text"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.explode_lines(_books(spark, sf_dir), "region")
    counts = lines.groupBy("region").agg(F.count_if(F.col("line").rlike(P.any_of(P.FRONT_MATTER))).alias("front"), F.count_if(F.col("line").rlike(P.any_of(P.BACK_MATTER))).alias("back"))
    parts = S.numbered_lines(lines, "region", P.BOOK_PARTS).groupBy("region").agg(F.count(F.lit(1)).alias("parts"))
    sections = S.numbered_lines(lines, "region", P.BOOK_SECTIONS).groupBy("region").agg(F.count(F.lit(1)).alias("sections"))
    toc = S.book_contents(lines, "region").groupBy("region").agg(F.count("page").alias("entries"), F.sum("page").alias("pages"))
    return counts.join(parts, "region").join(sections, "region").join(toc, "region")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.explode_lines(_books(spark, sf_dir), "region")
    return S.numbered_lines(lines, "region", P.BOOK_CHAPTERS).select("region", "number", "title")


def _manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = _joined(_nations(spark, sf_dir), "region", "n_nationkey", F.expr("concat('1. Open ', n_name, '\\n2) Wait\\nWARNING: hot ', n_name)"))
    text = F.concat(F.lit("Product guide\nRequirements\n- one\n2) two\n# Installation\n"), "body", F.lit("\n## Usage\n $ run --fast\n```py\nx = 1\n```\n## Troubleshooting\n[TIP] try again"))
    return step.select("region", text.alias("text"))


def manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _manuals(spark, sf_dir)
    lines = S.explode_lines(docs, "region")
    steps = S.procedures(lines, "region").groupBy("region").agg(F.count(F.lit(1)).alias("procedures"), F.sum("steps").alias("steps"))
    notes = S.callouts(lines, "region").groupBy("region").agg(F.count_if(F.col("kind") == "warning").alias("warnings"), F.count_if(F.col("kind") == "tip").alias("tips"))
    needs = S.requirements(lines, "region").groupBy("region").agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("needs"))
    code = S.code_blocks(docs, "region", "text").groupBy("region").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("code"))
    kinds = S.manual_type(S.manual_sections(lines, "region"), docs, "region", "text")
    return steps.join(notes, "region").join(needs, "region").join(code, "region").join(kinds, "region")


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _joined(_nations(spark, sf_dir), "region", "n_nationkey", F.expr("concat(if(n_nationkey % 4 = 0, concat('Slide ', n_nationkey + 50), '---'), '\\n# ', n_name, '\\n- one\\n* two\\nNotes: say ', n_name)"))
    deck = body.select("region", F.concat(F.lit("# Deck\n- hello\n"), "body").alias("text"))
    return S.slides(S.explode_lines(deck, "region"), "region").select("region", "slide", "title", "bullets", "notes", "number")


def _resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(
        "concat('Anna Maria Smith\\nmail: s', s_suppkey, '@example.com\\n', if(s_suppkey % 2 = 0, 'Phone +1 555 123 4567\\n', ''), 'Education\\nBachelor of Art, ', s_nationkey + 1990, "
        "'\\nExperience\\nEngineer at ', s_name, '\\nSkills\\npython, sql | spark', s_nationkey, '\\n- expert level\\nLanguages\\nEnglish: fluent')"
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text"))


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.resume_fields(_resumes(spark, sf_dir), "text")
    return found.select("s_suppkey", "name", "mail", F.array_join("skills", ",").alias("skills"), F.array_join("degrees", ",").alias("degrees"),
                        F.array_join("sections", ",").alias("sections"), "confidence")


def resume_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as people with schools, jobs, certificates and languages; some have none of one kind."""
    text = F.expr(
        "concat('Anna Smith\nBased in: City ', s_nationkey, '\nEducation\n', if(s_suppkey % 3 = 0, '', concat('Bachelor of Art\nCollege ', s_nationkey, '\n2001 - 2005\nMajor: Field', s_suppkey, ', x\n')), "
        "'Work history\nSenior Engineer\nAcme ', s_suppkey, '\nMay 2010 - Present\nBuilt it', if(s_suppkey % 2 = 0, concat('\n\nOther Corp ', s_nationkey, '\nworker of things'), ''), "
        "'\nCertifications\n- Certificate ', s_suppkey, '\n* abc\nLanguages\n- English: fluent\nGerman', if(s_suppkey % 4 = 0, '\nFrench (BASIC)', ''))"
    )
    found = resumes_of(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")), "text")
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.to_json(x)), ";")
    return found.select("s_suppkey", shown("education").alias("education"), shown("experience").alias("experience"), F.array_join("certifications", ";").alias("certifications"), shown("languages").alias("languages"), "location")


def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of structured resumes: people 30, career 20, education 25 and experience 25 of a hundred; degrees by rank."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    has = lambda n: F.when(key % n != 0, 1).otherwise(0)
    personal = (has(2) + has(3) + has(5) + 1) * 7.5
    career = (has(4) + has(7)) * (20.0 / 3)
    education = F.when(key % 6 != 0, 15 + 5 * has(2) + 5 * has(3)).otherwise(0)
    experience = F.when(key % 8 != 0, 15 + 5 * has(3) + 5 * has(5)).otherwise(0)
    degrees = F.expr("array('PhD', 'Master of Art', 'BSc', 'bachelor of law', 'Diploma')")
    mine = F.slice(degrees, (key % 4 + 1).cast("int"), 2)
    best = F.array_max(F.transform(mine, lambda d: F.struct(S.degree_rank(d).alias("r"), d.alias("d"))))
    return c.select("c_custkey", F.round((personal + career + education + experience) / 100, 2).alias("integrity"), F.when(best["r"] > 0, best["d"]).alias("degree"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _joined(_nations(spark, sf_dir), "region", "n_nationkey", F.expr("concat('[', n_nationkey + 1, '] Author of ', n_name)"))
    text = F.concat(
        F.lit("17\nOn the matter of region "), F.col("region").cast("string"), F.lit(" today.\nAnna Smith, Bob Jones and Carla White\na@b.org\nAbstract\nWe show it [1, 2].\nTwice (Smith, 2020).\n"),
        F.lit("Keywords: one; two· three\n1. Introduction\nAs in [3].\nReferences\n"), "body", F.lit("\nAppendix\n[99] not a reference"),
    )
    return S.paper_fields(refs.select("region", text.alias("text")), "region", "text")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of rendered documents of every kind, by the best score."""
    kinds = {
        "legal": _legal(spark, sf_dir).select("text"), "table": _tables(spark, sf_dir).select("text"), "email": _mails(spark, sf_dir).select("text"),
        "qa": _explicit(spark, sf_dir).select(F.col("body").alias("text")), "book": _books(spark, sf_dir).select("text"), "manual": _manuals(spark, sf_dir).select("text"),
        "resume": spread(_resumes(spark, sf_dir).select("text")), "general": spread(table(spark, sf_dir, "documents").select("text")),
    }
    all_docs = None
    for kind, docs in kinds.items():
        docs = docs.withColumn("made_as", F.lit(kind))
        all_docs = docs if all_docs is None else all_docs.unionByName(docs)
    found = S.classify(all_docs, "text", F.lit("file.bin"))
    return found.groupBy("made_as", "document_type").agg(F.count(F.lit(1)).alias("n"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each part, of one of four kinds: explicit, bulleted, numbered, with question marks alone."""
    text = F.expr(
        "case p_partkey % 4 when 0 then concat('Q: What is ', p_name, '?\\nA: Costs ', p_retailprice, '\\nand size ', p_size, '\\nQ: What is  ', upper(p_name), '?\\nA: twice') "
        "when 1 then concat('Intro words\\n1. Really? The ', p_name, '\\nanswer line\\n\\nmore of it\\n2. Again? Size ', p_size, ' is what? yes\\nend') "
        "when 2 then concat('1. Is ', p_name, ' good?\\nYes it is ', p_size) "
        "else concat('How large is ', p_name, '?\\n\\nIt is ', p_size, '\\nat most\\n\\n\\nNoise\\nWhy is it so cheap?\\nshort?\\nNobody knows') end"
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


def qa_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.qa_pairs(_questions(spark, sf_dir), "p_partkey").select("p_partkey", "number", "question", "answer", "form")


def answer_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.answer_lengths(Q.qa_pairs(_questions(spark, sf_dir), "p_partkey"), "p_partkey")


_QA_SQL = """
q AS (
    SELECT p_partkey, NULL AS number, 'What is ' || p_name || '?' AS question, 'Costs ' || p_retailprice || chr(10) || 'and size ' || p_size AS answer, 'explicit' AS form FROM part WHERE p_partkey % 4 = 0
    UNION ALL SELECT p_partkey, '1', 'The ' || p_name, 'answer line more of it', 'bullet' FROM part WHERE p_partkey % 4 = 1
    UNION ALL SELECT p_partkey, '2', 'Size ' || p_size || ' is what?', 'yes end', 'bullet' FROM part WHERE p_partkey % 4 = 1
    UNION ALL SELECT p_partkey, '1', 'Is ' || p_name || ' good?', 'Yes it is ' || p_size, 'numbered' FROM part WHERE p_partkey % 4 = 2
    UNION ALL SELECT p_partkey, NULL, 'How large is ' || p_name || '?', 'It is ' || p_size || ' at most', 'question_mark' FROM part WHERE p_partkey % 4 = 3
    UNION ALL SELECT p_partkey, NULL, 'Why is it so cheap?', 'short? Nobody knows', 'question_mark' FROM part WHERE p_partkey % 4 = 3)"""
_REG = "SELECT n_regionkey AS region, n_nationkey, n_name FROM nation"
_LEGAL_LINES = f"""
n AS ({_REG}),
l AS (SELECT region, 0 AS a, 0 AS b, 0 AS c, 'PART ' || ['ONE','TWO','THREE','FOUR','FIVE'][region + 1] AS line, 'part' AS level, ['ONE','TWO','THREE','FOUR','FIVE'][region + 1] AS number, '' AS title FROM (SELECT DISTINCT region FROM n)
      UNION ALL SELECT DISTINCT region, 1, 0, 0, '', NULL, NULL, NULL FROM n
      UNION ALL SELECT DISTINCT region, 2, 0, 0, 'Section 1. Scope', 'chapter', 'Section 1', 'Scope' FROM n
      UNION ALL SELECT region, 3, n_nationkey, 0, 'Article ' || n_nationkey || ': ' || n_name, 'chapter', 'Article ' || n_nationkey, n_name FROM n
      UNION ALL SELECT region, 3, n_nationkey, 1, 'The party shall not be liable under this agreement.', NULL, NULL, NULL FROM n
      UNION ALL SELECT DISTINCT region, 4, 0, 0, 'DEFINITIONS', NULL, NULL, NULL FROM n
      UNION ALL SELECT region, 5, n_nationkey, 0, '"' || n_name || '" means the nation numbered ' || n_nationkey || ';', NULL, NULL, NULL FROM n
      UNION ALL SELECT DISTINCT region, 6, 0, 0, 'Section 2. Rest', 'chapter', 'Section 2', 'Rest' FROM n),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY region ORDER BY a, b, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM l)
"""
_QA = "row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)"

QUERIES = {
    "h4_d1e_merged_sections": merged_sections,
    "d3_cascade": qa_cascade,
    "d3_a16_answer_lengths": answer_lengths,
    "d1_w3_w4_legal_headings": legal_headings,
    "d1_legal_definitions": legal_definitions,
    "d1_legal_subtype": legal_subtype,
    "h0_h1_h2_a7_a8_a9_sets": bullet_sets,
    "h3_title_paths": title_paths,
    "d4_a6_h6_table_columns": table_columns,
    "d4_a5_table_statistics": table_statistics,
    "d4_s6_table_rows": table_rows,
    "d6_t18_mails": mails,
    "d3_qa_explicit": qa_explicit,
    "d3_qa_numbered": qa_numbered,
    "d3_w10_qa_content": qa_content,
    "d5_books": books,
    "d5_chapters": chapters,
    "d7_w8_manuals": manuals,
    "d8_w9_a12_slides": slides,
    "d9_resumes": resumes,
    "d9_resume_entries": resume_entries,
    "a15_a17_integrity": integrity,
    "d2_papers": papers,
    "d0_classified": classified,
}
ORACLES = {
    "d3_cascade": f"WITH {_QA_SQL} SELECT * FROM q",
    "d3_a16_answer_lengths": f"WITH {_QA_SQL} SELECT p_partkey, count(*) AS pairs, sum(length(answer))::BIGINT // count(*) AS average_answer_length FROM q GROUP BY 1",
    "d1_w3_w4_legal_headings": f"""
        WITH {_LEGAL_LINES} SELECT region, level, number, title, "offset", lead("offset") OVER (PARTITION BY region ORDER BY a, b, c) AS next_offset FROM o WHERE level IS NOT NULL""",
    "d1_legal_definitions": "SELECT n_regionkey AS region, n_name AS term, 'the nation numbered ' || n_nationkey AS definition FROM nation",
    "d1_legal_subtype": "SELECT DISTINCT n_regionkey AS region, 'contract' AS subtype FROM nation",
    "h0_h1_h2_a7_a8_a9_sets": """
        SELECT DISTINCT n_regionkey AS region, 2 AS bullet_set, 1 AS common_level, -1 AS question_set FROM nation
        UNION ALL SELECT DISTINCT n_regionkey + 100, 1, 3, -1 FROM nation""",
    "h3_title_paths": """
        SELECT DISTINCT n_regionkey AS region, '# Region ' || n_regionkey AS path, 'intro' AS body FROM nation
        UNION ALL SELECT n_regionkey, '# Region ' || n_regionkey || ' > ## ' || n_name, 'body of ' || lower(n_name) || chr(10) || 'more of it' FROM nation""",
    "d4_a6_h6_table_columns": """
        WITH o AS (SELECT l_orderkey, CASE WHEN count(*) FILTER (l_partkey = 0) > count(*) FILTER (l_partkey > 0) THEN 'text' ELSE 'int' END AS part FROM lineitem GROUP BY l_orderkey),
        t AS (SELECT unnest(['part','qty','price','shipped','flag','late']) AS header, unnest([part,'int','float','datetime','text','bool']) AS type FROM o)
        SELECT header, type, count(*) AS tables FROM t GROUP BY header, type""",
    "d4_a5_table_statistics": """
        WITH v AS (SELECT l_orderkey, 'qty' AS header, l_quantity::INT::DOUBLE AS x FROM lineitem
                   UNION ALL SELECT l_orderkey, 'price', l_extendedprice::DECIMAL(20,2)::DOUBLE FROM lineitem)
        SELECT l_orderkey, header, min(x) AS least, max(x) AS most, round(sum(x), 2) AS total, count(*) AS n FROM v GROUP BY ALL""",
    "d4_s6_table_rows": "SELECT l_orderkey, l_partkey AS part, l_extendedprice::DECIMAL(20,2)::VARCHAR AS price, strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem",
    "d6_t18_mails": """
        SELECT o_orderkey, c_name AS sender_name, 'c' || c_custkey || '@mail.example.com' AS sender_mail, (2 + (o_orderkey % 2 = 0)::INT)::INT AS recipients,
               ['Re: ', 'Fwd: ', ''][o_orderkey % 3 + 1] || 'Order ' || o_orderkey AS subject, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS sent,
               o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 AS is_reply, o_orderkey % 3 = 1 AS is_forward,
               greatest((o_orderkey % 3 = 0)::INT, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END)::INT AS depth, 'Best regards,' || chr(10) || c_name AS signature,
               array_to_string([x FOR x IN [CASE WHEN o_orderkey % 4 = 0 THEN 'bill.pdf|12 KB' END, CASE WHEN o_orderkey % 7 = 0 THEN 'notes.txt|' END,
                   CASE WHEN o_orderkey % 7 = 0 THEN 'scan' || o_custkey || '.PDF|3 KB' END] IF x IS NOT NULL], ',') AS attachments FROM orders JOIN customer ON o_custkey = c_custkey""",
    "d3_qa_explicit": f"SELECT p_brand, ({_QA} - 1)::INT AS at, 'What is ' || p_name || '?' AS question, 'Costs ' || p_retailprice || chr(10) || 'and size ' || p_size AS answer FROM part",
    "d3_qa_numbered": """
        SELECT p_brand, p_partkey::VARCHAR AS number, 'Is ' || CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_type END || ' good?' AS question,
               CASE WHEN p_size % 5 = 0 THEN 'Yes it is.' ELSE 'No. Or ' || p_size END AS answer, CASE WHEN p_size % 5 = 0 THEN 'numbered_inline' ELSE 'numbered' END AS form FROM part""",
    "d3_w10_qa_content": """
        WITH q AS (SELECT *, lower('Is ' || CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_type END || ' good?') AS k FROM part),
        f AS (SELECT *, row_number() OVER (PARTITION BY p_brand, k ORDER BY p_partkey) AS n FROM q)
        SELECT p_brand, md5(string_agg('Q' || p_partkey || ': Is ' || CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_type END || ' good?' || chr(10) || chr(10) || 'A' || p_partkey || ': ' ||
                        CASE WHEN p_size % 5 = 0 THEN 'Yes it is.' ELSE 'No. Or ' || p_size END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY p_partkey)) AS h, count(*) AS pairs
        FROM f WHERE n = 1 GROUP BY p_brand""",
    "d5_books": "SELECT n_regionkey AS region, CASE WHEN n_regionkey % 2 = 0 THEN 2 ELSE 1 END AS front, CASE WHEN n_regionkey % 2 = 0 THEN 2 ELSE 1 END AS back, 1 AS parts, count(*) AS sections, count(*) AS entries, sum(n_nationkey + 1)::BIGINT AS pages FROM nation GROUP BY 1",
    "d5_chapters": "SELECT n_regionkey AS region, (n_nationkey + 1)::VARCHAR AS number, n_name AS title FROM nation",
    "d7_w8_manuals": """
        SELECT n_regionkey AS region, count(*) AS procedures, 2 * count(*) AS steps, count(*) AS warnings, 1 AS tips, 'one,two' AS needs, 'run --fast,x = 1' AS code, 'installation_guide' AS manual_type
        FROM nation GROUP BY 1""",
    "d8_w9_a12_slides": f"""
        WITH n AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n_nationkey) + 1 AS slide FROM ({_REG})),
        x AS (SELECT *, arg_max(n_nationkey + 50, slide) FILTER (n_nationkey % 4 = 0) OVER w AS base, max(slide) FILTER (n_nationkey % 4 = 0) OVER w AS at_slide FROM n
              WINDOW w AS (PARTITION BY region ORDER BY slide ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT region, slide, n_name AS title, 2 AS bullets, 1 AS notes, coalesce(base + slide - at_slide, slide)::INT AS number FROM x
        UNION ALL SELECT DISTINCT region, 1, 'Deck', 1, 0, 1 FROM n""",
    "d9_resume_entries": """
        SELECT s_suppkey, 'City ' || s_nationkey AS location, ' Certificate ' || s_suppkey AS certifications,
               CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '{"degree":"Bachelor of","institution":"Bachelor of Art"};{"dates":"2001 - 2005","institution":"College ' || s_nationkey
                   || '"};{"institution":"Major: Field' || s_suppkey || ', x","major":"Field' || s_suppkey || '"}' END AS education,
               '{"position":"Senior Engineer","company":"Acme ' || s_suppkey || '","dates":"May 2010 - Present","description":"May 2010 - Present Built it"}'
                   || CASE WHEN s_suppkey % 2 = 0 THEN ';{"position":"worker of things","company":"Other Corp ' || s_nationkey || '"}' ELSE '' END AS experience,
               '{"language":"English","level":"Fluent"};{"language":"German","level":"Not specified"}' || CASE WHEN s_suppkey % 4 = 0 THEN ';{"language":"French (","level":"Basic"}' ELSE '' END AS languages
        FROM supplier""",
    "d9_resumes": """
        SELECT s_suppkey, 'Anna Maria Smith' AS name, 's' || s_suppkey || '@example.com' AS mail, ' expert level,python,spark' || s_nationkey || ',sql' AS skills, 'Bachelor of' AS degrees,
               'education,experience,languages,skills' AS sections, 0.95::DOUBLE AS confidence FROM supplier""",
    "a15_a17_integrity": """
        WITH c AS (SELECT c_custkey, c_custkey % 2 <> 0 AS b2, c_custkey % 3 <> 0 AS b3, c_custkey % 4 <> 0 AS b4, c_custkey % 5 <> 0 AS b5, c_custkey % 7 <> 0 AS b7 FROM customer)
        SELECT c_custkey, round(((b2::INT + b3::INT + b5::INT + 1) * 7.5::DOUBLE + (b4::INT + b7::INT) * (20.0::DOUBLE / 3)
                 + CASE WHEN c_custkey % 6 <> 0 THEN 15 + 5 * b2::INT + 5 * b3::INT ELSE 0 END + CASE WHEN c_custkey % 8 <> 0 THEN 15 + 5 * b3::INT + 5 * b5::INT ELSE 0 END) / 100, 2) AS integrity,
               ['PhD', 'Master of Art', 'bachelor of law', 'bachelor of law'][c_custkey % 4 + 1] AS degree FROM c""",
    "d2_papers": """
        SELECT n_regionkey AS region, 'On the matter of region ' || n_regionkey || ' today' AS title, 'Anna Smith; Bob Jones; Carla White' AS authors, 'We show it [1, 2]. Twice (Smith, 2020).' AS abstract,
               'one; two; three' AS keywords, count(*)::INT AS refs, (4 + count(*))::INT AS citations FROM nation GROUP BY n_regionkey""",
}
