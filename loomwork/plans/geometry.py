"""Registered queries on boxes (rendered from lineitem rows) and on files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.operators import geometry as G
from loomwork.operators import questions as Q
from loomwork.session import new_folder, table
from loomwork.sources import files

_BOX = """
    SELECT l_orderkey AS page, l_partkey AS box_id, l_linenumber % 2 AS family, {score} AS score,
           CAST(l_partkey % 60 AS DOUBLE) AS x0, CAST(l_suppkey % 50 AS DOUBLE) AS y0,
           CAST(l_partkey % 60 + 20 + l_linenumber AS DOUBLE) AS x1, CAST(l_suppkey % 50 + 30 AS DOUBLE) AS y1,
           CASE l_linenumber % 3 WHEN 0 THEN 'header' WHEN 1 THEN 'footer' ELSE 'reference' END AS kind
    FROM lineitem"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, one for each part of an order."""
    rows = spark.sql(_BOX.replace("lineitem", "{lines}").format(score="l_extendedprice", lines="{lines}"), lines=table(spark, sf_dir, "lineitem"))
    return rows.groupBy("page", "box_id").agg(*[F.max(c).alias(c) for c in ("family", "score", "x0", "y0", "x1", "y1", "kind")])


_UNIQUE = f"""boxes AS (SELECT page, box_id, max(family) AS family, max(score) AS score, max(x0) AS x0, max(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(kind) AS kind
    FROM ({_BOX.format(score="l_extendedprice")}) GROUP BY page, box_id)"""


def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.suppressed(_boxes(spark, sf_dir), ["page", "family"], "box_id")


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes of a page that share at least half of what they cover."""
    boxes = _boxes(spark, sf_dir)
    a = boxes.select("page", F.col("box_id").alias("a"), *[F.col(s).alias(f"a_{s}") for s in G.SIDES])
    b = boxes.select("page", F.col("box_id").alias("b"), *[F.col(s).alias(f"b_{s}") for s in G.SIDES])
    pairs = a.join(b, "page").filter("a < b").withColumn("iou", F.round(G.iou("a_", "b_"), 6))
    return pairs.filter("iou >= 0.5").select("page", "a", "b", "iou")


def page_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = G.without_margins(G.clipped(_boxes(spark, sf_dir), 70.0, 60.0), 60.0, 0.52)
    return inside.select("page", "box_id", "kind", G.area().alias("area"))


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of even parts as layout of those of odd parts."""
    boxes = _boxes(spark, sf_dir)
    texts = boxes.filter("box_id % 2 = 1").withColumnRenamed("box_id", "text_id")
    return G.assigned(texts, boxes.filter("box_id % 2 = 0").withColumnRenamed("box_id", "layout_id"), "page")


def chunk_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in folders by source and read back; the filter on the folder reads no other one."""
    path = f"{new_folder(spark, "chunks")}/chunks"
    files.write_chunks(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), path, "source")
    return spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def json_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of events as lines."""
    events = table(spark, sf_dir, "events")
    whole = F.concat("props", F.lit("\n"), "props")
    return events.select("event_id", files.flat_json(F.col("props")).alias("content"), files.json_lines_probe(whole).alias("is_lines"))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as boxes: three rows well apart, a few points up and down within a row."""
    boxes = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3 * 50 + F.col("l_partkey") % 7).cast("double").alias("top"), (F.col("l_suppkey") % 90).cast("double").alias("x0")
    )
    return G.reading_order(boxes, "l_orderkey", "l_linenumber", 10.0).select("l_orderkey", "l_linenumber", "place")


def aligned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 2 == 0, "table row").otherwise("table column")
    parts = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("page"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), kind.alias("kind"),
        *[(F.col(c) % m).cast("double").alias(x) for x, c, m in (("x0", "l_partkey", 40), ("y0", "l_suppkey", 30), ("x1", "l_orderkey", 97), ("y1", "l_partkey", 83))],
    )
    done = G.aligned(parts, "page")
    return done.select("o", "n", *[F.round(c, 6).alias(c) for c in G.SIDES])


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the images of their brand's document; small ones have no description."""
    images = table(spark, sf_dir, "part").select(
        "p_brand", (F.col("p_size") % 4).alias("page"), F.col("p_partkey").alias("index"),
        F.expr("cast(repeat('x', cast(p_size as int) * 100) as binary)").alias("image"), F.col("p_name").alias("description"),
    )
    return files.figures(images, "p_brand").select("p_brand", F.md5("figures").alias("h"))


_BYTES = ("unhex('255044462D312E37')", "unhex('89504E470D0A1A0A00')", "encode('<!DOCTYPE html><p>', 'UTF-8')", "encode('plain', 'UTF-8')", "unhex('1F8B08')", "unhex('')")


def file_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type by first bytes, text by encoding, and rate of frames, of contents that depend on the event."""
    k = F.col("event_id")
    data = F.element_at(F.expr(f"array({', '.join(_BYTES)})"), (k % len(_BYTES) + 1).cast("int"))
    text = F.expr("case event_id % 3 when 0 then encode(concat('\ufeff', event_type), 'UTF-8') when 1 then encode(concat('caf\u00e9 ', event_type), 'UTF-8') else concat(unhex('636166E920'), encode(event_type, 'UTF-8')) end")
    rate = F.expr("case event_id % 4 when 0 then '30000/1001' when 1 then '25/1' when 2 then '0/0' else 'none' end")
    probed = table(spark, sf_dir, "events").select(files.sniffed_type(data).alias("type"), files.decoded(text).alias("text"), files.frame_rate(rate).alias("fps"))
    return probed.groupBy("type", "text", "fps").agg(F.count(F.lit(1)).alias("n"))


def _ranked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order))


def built_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each order as boxes of a table, a little askew, with two captions; some cells span two columns."""
    lines = _ranked_lines(spark, sf_dir)
    wide = F.col("l_suppkey") % 4 == 0
    top = (100 + 20 * F.col("n") + F.col("l_partkey") % 3).cast("double")
    texts = [F.col("l_partkey").cast("string"), F.concat(F.lit(" "), F.col("l_suppkey").cast("string")), F.when(~wide, F.col("l_returnflag"))]

    def box(n, i: int, x0, y0, text, layout="", span=None):
        sides = (x0, y0, x0 + 40, y0 + 14)
        return F.struct(
            (n * 10 + i).alias("box_id"), *[F.lit(v).cast("double").alias(n) if isinstance(v, (int, float)) else v.cast("double").alias(n) for n, v in zip(G.SIDES, sides, strict=True)],
            text.alias("text"), F.lit(layout).alias("layout"), (F.lit(None) if span is None else span).cast("int").alias("colspan"), F.lit(None).cast("int").alias("rowspan"),
        )

    cells = [box(F.col("n"), c, 10 + 50 * c + F.col("l_suppkey") % 5, top, t, span=F.when(wide, 2) if c == 1 else None) for c, t in enumerate(texts)]
    heads = [box(F.lit(0), c, 10 + 50 * c, 100, F.lit(t)) for c, t in enumerate(("part", "supplier", "flag"))]
    heads += [box(F.lit(0), 3, 10, 60, F.concat(F.lit("Table "), F.col("l_orderkey").cast("string"), F.lit(": lines"))), box(F.lit(0), 4, 10, 900, F.lit("lines of an order"), "table caption")]
    listed = F.when(F.col("n") == 1, F.concat(F.array(*heads), F.array(*cells))).otherwise(F.array(*cells))
    boxes = lines.select("l_orderkey", F.explode(listed).alias("b")).filter("b.text is not null").select("l_orderkey", "b.*")
    return G.built_tables(boxes, "l_orderkey", "box_id")


def question_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each order as boxes with numbered questions at changing left edges and heights."""
    text = F.expr(
        "element_at(array(concat(n, '. Is it? The part ', l_partkey), concat(l_suppkey % 5 + 1, '. So it? Really ', l_partkey, '? Yes'), "
        "concat('plain ', l_partkey), concat('colon ', l_partkey, ':')), cast(l_partkey % 4 + 1 as int))"
    )
    box = F.struct(
        "n", text.alias("text"), (F.col("l_suppkey") % 4 * 8).cast("double").alias("x0"), (15 * F.col("n") + F.col("l_partkey") % 3 * 10).cast("double").alias("top"),
        F.when(F.col("l_partkey") % 7 == 0, "title").otherwise("").alias("layout"),
    )
    docs = _ranked_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    return Q.box_pairs(docs, "l_orderkey", "boxes").select("l_orderkey", F.col("at").cast("long").alias("at"), "number", "question", "answer")


_FOUND = """
    SELECT l_orderkey % 40 AS page, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id, max(l_linenumber % 12) AS class, max(l_extendedprice % 1000 / 1000) AS score,
           CAST(max(l_partkey * 7 % 900) AS DOUBLE) AS x0, CAST(max(l_suppkey * 13 % 900) AS DOUBLE) AS y0,
           CAST(max(l_partkey * 7 % 900 + 60 + l_linenumber) AS DOUBLE) AS x1, CAST(max(l_suppkey * 13 % 900 + 80) AS DOUBLE) AS y1
    FROM lineitem GROUP BY l_orderkey % 40, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as a model's detections on forty pages of several sizes."""
    found = spark.sql(_FOUND.replace("lineitem", "{lines}"), lines=table(spark, sf_dir, "lineitem"))
    pages = spark.range(40).select(F.col("id").alias("page"), (800 + F.col("id") * 10).cast("double").alias("width"), (1100 - F.col("id") * 7).cast("double").alias("height"))
    boxes = G.layout_boxes(found, pages, "page", "id", least=0.3)
    return boxes.select("page", "id", "kind", *[F.round(s, 4).alias(s) for s in G.SIDES])


QUERIES = {
    "v4_layout_boxes": detections,
    "v8_built_tables": built_tables,
    "h5_question_boxes": question_boxes,
    "k8_reading_order": reading_order,
    "v7_aligned_tables": aligned_tables,
    "s13_figures": figures,
    "s2_s11_t24_file_probes": file_probes,
    "v1_v2_suppressed_boxes": suppressed_boxes,
    "v2_overlaps": overlaps,
    "v5_page_margins": page_margins,
    "v6_layouts": layouts,
    "s16_s14_chunk_sink": chunk_sink,
    "s4_json_sections": json_sections,
}
_SHARED = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
_RANKED = "li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)"
ORACLES = {
    "v4_layout_boxes": f"""
        WITH RECURSIVE f AS ({_FOUND}),
        p AS (SELECT id AS page, 800 + id * 10.0::DOUBLE AS w, 1100 - id * 7.0::DOUBLE AS h FROM range(40) AS t(id)),
        i AS (SELECT *, floor(w * least(1024 / h, 1024 / w)) AS nw, floor(h * least(1024 / h, 1024 / w)) AS nh FROM p),
        b AS (SELECT f.page, id, class, score, (x0 - (1024 - nw) / 2) * (w / nw) AS x0, (y0 - (1024 - nh) / 2) * (h / nh) AS y0, (x1 - (1024 - nw) / 2) * (w / nw) AS x1, (y1 - (1024 - nh) / 2) * (h / nh) AS y1,
                     row_number() OVER (PARTITION BY f.page, class ORDER BY score DESC, id) AS r FROM f JOIN i ON i.page = f.page WHERE score >= 0.3),
        g(page, class, r, kept, id, new) AS (
            SELECT page, class, 1::BIGINT, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}], id, true FROM b WHERE r = 1
            UNION ALL
            SELECT page, class, r, CASE WHEN hit THEN kept ELSE list_append(kept, {{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}) END, id, NOT hit FROM (
                SELECT b.*, g.kept, len(list_filter(g.kept, lambda k: greatest(least(k.x1, b.x1) - greatest(k.x0, b.x0), 0) * greatest(least(k.y1, b.y1) - greatest(k.y0, b.y0), 0)
                    > 0.45 * ((k.x1 - k.x0) * (k.y1 - k.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(least(k.x1, b.x1) - greatest(k.x0, b.x0), 0) * greatest(least(k.y1, b.y1) - greatest(k.y0, b.y0), 0) + 1e-6))) > 0 AS hit
                FROM g JOIN b ON b.page = g.page AND b.class = g.class AND b.r = g.r + 1))
        SELECT b.page, b.id, {list(G.LAYOUTS)}[b.class + 1] AS kind, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1
        FROM g JOIN b ON b.page = g.page AND b.class = g.class AND b.id = g.id WHERE g.new AND b.class < 10""",
    "v8_built_tables": f"""
        WITH {_RANKED}
        SELECT l_orderkey,
               '<table>' || chr(10) || '  <tr>' || chr(10) || '    <th>part</th>' || chr(10) || '    <th>supplier</th>' || chr(10) || '    <th>flag</th>' || chr(10) || '  </tr>' || chr(10)
               || string_agg('  <tr>' || chr(10) || '    <td>' || l_partkey || '</td>' || chr(10)
                   || CASE WHEN l_suppkey % 4 = 0 THEN '    <td colspan="2">' || l_suppkey || '</td>' || chr(10)
                      ELSE '    <td>' || l_suppkey || '</td>' || chr(10) || '    <td>' || l_returnflag || '</td>' || chr(10) END || '  </tr>' || chr(10), '' ORDER BY n) || '</table>' AS html,
               'part | supplier | flag' || chr(10) || string_agg(l_partkey || ' | ' || l_suppkey || CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE ' | ' || l_returnflag END, chr(10) ORDER BY n) AS plain
        FROM li GROUP BY l_orderkey""",
    "h5_question_boxes": f"""
        WITH RECURSIVE {_RANKED},
        b AS (SELECT l_orderkey AS o, n, l_partkey % 4 AS k, l_partkey AS p, CASE l_partkey % 4 WHEN 0 THEN n WHEN 1 THEN l_suppkey % 5 + 1 END AS num, l_suppkey % 4 * 8.0 AS x0,
                     15 * n + l_partkey % 3 * 10 AS top, l_partkey % 7 = 0 AS title FROM li),
        m AS (SELECT *, k < 2 AND coalesce(lag(k) OVER w <> 3, true) AS marked, x0 - coalesce(lag(x0) OVER w, x0) AS dx, top - coalesce(lag(top) OVER w, top) AS dy FROM b WINDOW w AS (PARTITION BY o ORDER BY n)),
        f(o, n, hit, last, begun, edges, cnt) AS (
            SELECT o, 0::BIGINT, false, 0::BIGINT, false, 0.0::DOUBLE, 0::BIGINT FROM m WHERE n = 1
            UNION ALL
            SELECT o, n, hit, CASE WHEN hit THEN num ELSE last END, begun OR hit, edges + CASE WHEN hit THEN x0 ELSE 0 END, cnt + hit::INT FROM (
                SELECT m.o, m.n, m.num, m.x0, f.last, f.begun, f.edges, f.cnt,
                       m.marked AND (CASE WHEN f.begun THEN dx <= 10 ELSE NOT (dx >= 0 AND dy < 20) END)
                       AND m.x0 - (CASE WHEN f.cnt > 0 THEN f.edges / f.cnt ELSE m.x0 END) <= 10 AND (f.last = 0 OR m.num >= f.last OR m.title) AS hit
                FROM f JOIN m ON m.o = f.o AND m.n = f.n + 1)),
        q AS (SELECT f.o, f.n, f.hit, b.num, b.k, b.p, sum(f.hit::INT) OVER (PARTITION BY f.o ORDER BY f.n) AS g FROM f JOIN b ON b.o = f.o AND b.n = f.n),
        t AS (SELECT *, CASE k WHEN 0 THEN n || '. Is it? The part ' || p WHEN 1 THEN num || '. So it? Really ' || p || '? Yes' WHEN 2 THEN 'plain ' || p ELSE 'colon ' || p || ':' END AS line FROM q WHERE g > 0),
        a AS (SELECT o, g, max(num) FILTER (hit) AS num, max(CASE k WHEN 0 THEN 'The part ' || p ELSE 'Really ' || p || '?' END) FILTER (hit) AS question,
                     string_agg(CASE WHEN hit THEN CASE WHEN k = 1 THEN 'Yes' END ELSE line END, ' ' ORDER BY n) AS answer FROM t GROUP BY o, g)
        SELECT o AS l_orderkey, row_number() OVER (PARTITION BY o ORDER BY g) - 1 AS "at", num::VARCHAR AS number, question, answer FROM a WHERE answer IS NOT NULL""",
    "k8_reading_order": "SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3, l_suppkey % 90, l_partkey % 7, l_linenumber) - 1)::INT AS place FROM lineitem",
    "v7_aligned_tables": """
        WITH p AS (SELECT l_orderkey % 500 AS page, l_orderkey AS o, l_linenumber AS n, l_linenumber % 2 = 0 AS r, (l_partkey % 40)::DOUBLE AS x0, (l_suppkey % 30)::DOUBLE AS y0,
                          (l_orderkey % 97)::DOUBLE AS x1, (l_partkey % 83)::DOUBLE AS y1 FROM lineitem),
        e AS (SELECT page, r, count(*) > 4 AS many, avg(x0) AS ax0, min(x0) AS lx0, avg(x1) AS ax1, max(x1) AS hx1, median(y0) AS my0, min(y0) AS ly0, median(y1) AS my1, max(y1) AS hy1 FROM p GROUP BY ALL)
        SELECT o, n, round(CASE WHEN p.r THEN least(x0, CASE WHEN many THEN ax0 ELSE lx0 END) ELSE x0 END, 6) AS x0, round(CASE WHEN p.r THEN y0 ELSE least(y0, CASE WHEN many THEN my0 ELSE ly0 END) END, 6) AS y0,
               round(CASE WHEN p.r THEN greatest(x1, CASE WHEN many THEN ax1 ELSE hx1 END) ELSE x1 END, 6) AS x1, round(CASE WHEN p.r THEN y1 ELSE greatest(y1, CASE WHEN many THEN my1 ELSE hy1 END) END, 6) AS y1
        FROM p JOIN e ON p.page = e.page AND p.r = e.r""",
    "s13_figures": """
        SELECT p_brand, md5(string_agg('### Figure ' || (p_partkey + 1) || CASE WHEN p_size % 4 > 0 THEN ' (Page ' || (p_size % 4) || ')' ELSE '' END || chr(10) || chr(10) || p_name || chr(10), chr(10)
                                       ORDER BY p_size % 4, p_partkey)) AS h FROM part WHERE p_size >= 10 GROUP BY 1""",
    "s2_s11_t24_file_probes": """
        SELECT CASE event_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/html' WHEN 4 THEN 'application/gzip' END AS type,
               CASE event_id % 3 WHEN 0 THEN event_type ELSE 'caf' || chr(233) || ' ' || event_type END AS text,
               CASE event_id % 4 WHEN 0 THEN 29.97 WHEN 1 THEN 25.0 ELSE 0.0 END::DOUBLE AS fps, count(*) AS n FROM events GROUP BY ALL""",
    "v2_overlaps": f"""
        WITH {_UNIQUE}, p AS (
            SELECT a.page, a.box_id AS a, b.box_id AS b, {_SHARED} AS s, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS t
            FROM boxes a JOIN boxes b ON a.page = b.page AND a.box_id < b.box_id)
        SELECT page, a, b, round(s / (t - s + 0.000001::DOUBLE), 6) AS iou FROM p WHERE round(s / (t - s + 0.000001::DOUBLE), 6) >= 0.5""",
    "v5_page_margins": f"""
        WITH {_UNIQUE}, c AS (SELECT page, box_id, kind, least(x0, 70.0::DOUBLE) AS x0, least(x1, 70.0::DOUBLE) AS x1, least(y0, 60.0::DOUBLE) AS y0, least(y1, 60.0::DOUBLE) AS y1 FROM boxes)
        SELECT page, box_id, kind, (x1 - x0) * (y1 - y0) AS area FROM c
        WHERE NOT (kind = 'header' AND y1 < 60 * 0.52) AND NOT (kind = 'footer' AND y0 > 60 * (1 - 0.52))""",
    "v6_layouts": f"""
        WITH {_UNIQUE}, t AS (SELECT * FROM boxes WHERE box_id % 2 = 1), l AS (SELECT * FROM boxes WHERE box_id % 2 = 0),
        m AS (SELECT a.page, a.box_id AS text_id, b.kind, {_SHARED} / ((a.x1 - a.x0) * (a.y1 - a.y0)) AS share, b.box_id AS lid FROM t a JOIN l b ON a.page = b.page),
        r AS (SELECT *, row_number() OVER (PARTITION BY page, text_id ORDER BY share DESC, lid) AS n FROM m WHERE share >= 0.4)
        SELECT t.page, t.box_id AS text_id, r.kind FROM t LEFT JOIN r ON t.page = r.page AND t.box_id = r.text_id AND r.n = 1""",
    "s16_s14_chunk_sink": "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source",
    "s4_json_sections": "SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS content, true AS is_lines FROM events",
}
