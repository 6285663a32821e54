"""Registered queries on files of mail and slides, rendered from rows; the SQL gets its answers from those rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwork.session import new_folder, spread, staged, table
from loomwork.sources import files, mail, slides
from loomwork.sources.store import Store, delete_cascade, updated


def mail_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested multipart mails: two of three have a plain text, two of three an attachment."""
    k = F.col("o_orderkey").cast("string")
    edge = lambda name, end="": F.concat(F.lit(f"\n--{name}"), k, F.lit(end))
    plain = F.concat(edge("in"), F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\nTotal =3D "), F.col("o_custkey").cast("string"), F.lit(" =E2=82=AC=\n, order "), k)
    html = F.concat(F.lit("<html><style>b {}</style><p>Order <b>"), k, F.lit("</b> &amp; more</p>\n</html>"))
    rich = F.concat(edge("in"), F.lit("\nContent-Type: text/html;\n charset=\"utf-8\"\nContent-Transfer-Encoding: BASE64\n\n"), F.base64(F.encode(html, "UTF-8")))
    file = F.concat(F.lit("part,customer\n"), k, F.lit(","), F.col("o_custkey").cast("string"))
    added = F.concat(
        edge("out"), F.lit("\nContent-Type: text/csv\nContent-Disposition: attachment;\n filename=\"o"), k, F.lit(".csv\"\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.encode(file, "UTF-8"))
    )
    third = F.col("o_orderkey") % 3
    text = F.concat(
        F.lit("From: Shop <shop@example.com>\nTo: c"), F.col("o_custkey").cast("string"), F.lit("@example.com\nSubject: =?utf-8?Q?Gr=C3=BC=C3=9Fe_?=\n =?utf-8?B?"), F.base64(F.encode(k, "UTF-8")),
        F.lit("?=\nContent-Type: multipart/mixed; boundary=\"out"), k, F.lit("\"\n\nfor old readers"), edge("out"), F.lit("\nContent-Type: multipart/alternative;\n boundary=in"), k, F.lit("\n"),
        F.when(third == 0, "").otherwise(plain), rich, edge("in", "--"), F.lit("\nnothing here"), F.when(third == 1, "").otherwise(added), edge("out", "--"), F.lit("\n"),
    )
    # Keys are spread, not the mails that are made of them.
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    files = orders.select("o_orderkey", F.encode(text, "UTF-8").alias("raw"))
    found = mail.mail_contents(files, "o_orderkey", "raw")
    names = F.array_join(F.transform("attachments", lambda a: F.concat_ws("|", a["filename"], a["content_type"], a["size"].cast("string"))), ",")
    return found.select("o_orderkey", "content", names.alias("attachments"), "has_html", "has_plain_text")


def slide_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decks with a slide a line: a text, and a group of bullets and of another group with a table; a picture."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order))
    lines = staged(lines.select("l_orderkey", "n", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"), "lines")  # texts and pictures read them
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    none = F.lit(None)

    def shape(i, parent, kind, top, left, paragraphs=none, cells=none, media=none):
        return F.struct(
            F.lit(i).cast("long").alias("shape_id"), F.lit(parent).cast("long").alias("parent_id"), F.lit(i).alias("seq"), F.lit(kind).alias("kind"), top.cast("double").alias("top"),
            left.cast("double").alias("left"), paragraphs.cast("array<struct<text:string,level:int,bullet:boolean>>").alias("paragraphs"), cells.cast("array<array<string>>").alias("cells"),
            media.cast("string").alias("media_type"),
        )

    para = lambda t, level=0, bullet=False: F.struct(t.alias("text"), F.lit(level).alias("level"), F.lit(bullet).alias("bullet"))
    shapes = F.array(
        shape(1, None, "text", p % 50, s % 40, F.array(para(F.concat(F.lit("Part "), p.cast("string"))), para(F.lit("  ")))),
        shape(2, None, "group", s % 50, p % 40),
        shape(3, 2, "text", p % 30, s % 20, F.array(para(F.concat(F.lit("supplier "), s.cast("string")), 1, True))),
        shape(4, 2, "group", s % 30, p % 20),
        shape(5, 4, "table", F.lit(None), F.lit(None), cells=F.array(F.array(F.lit("qty"), F.lit("")), F.array(F.col("l_quantity").cast("int").cast("string"), F.col("l_returnflag")), F.array(F.lit(" "), F.lit("")))),
        shape(6, None, "picture", F.lit(0), F.lit(0), media=F.when(p % 2 == 0, "image/jpeg").otherwise("image/x-emf")),
    )
    rows = lines.select(F.col("l_orderkey").alias("deck"), F.col("n").alias("slide"), F.explode(shapes).alias("s")).select("deck", "slide", "s.*")
    pictures = slides.slide_pictures(rows).select("deck", "slide", "filename")
    return slides.slide_texts(rows).join(pictures, ["deck", "slide"], "left")


DOCUMENTS = StructType().add("user_id", "long").add("doc_id", "long").add("content", "string").add("content_hash", "string").add("collection", "string")
CHUNKS = StructType().add("user_id", "long").add("doc_id", "long").add("chunk", "integer").add("collection", "string")


def _stored(spark: SparkSession, sf_dir: str) -> tuple[Store, Store]:
    """All documents and their lines as chunks, in folders by collection, of three users."""
    owner = F.length("source") % 3
    docs = table(spark, sf_dir, "documents").select(
        owner.cast("long").alias("user_id"), "doc_id", F.concat("text", F.lit("#"), F.col("doc_id").cast("string")).alias("content"), F.col("source").alias("collection")
    )
    docs = docs.withColumn("content_hash", F.sha2("content", 256))
    path = new_folder(spark, "library")
    documents, chunks = Store(spark, f"{path}/documents", "collection", DOCUMENTS), Store(spark, f"{path}/chunks", "collection", CHUNKS)
    documents.append(docs)
    lines = docs.select("user_id", "doc_id", "collection", F.explode(F.sequence(F.lit(1), F.size(F.split("content", "\n")))).alias("chunk"))
    chunks.append(lines)
    return documents, chunks


def deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first collection and all documents with ids divisible by 10 are deleted with their chunks; what stays of each collection."""
    documents, chunks = _stored(spark, sf_dir)
    rows = documents.read()
    first = rows.groupBy("user_id").agg(F.min("collection").alias("collection")).filter("user_id = 1")
    delete_cascade([documents, chunks], staged(first, "keys"))
    delete_cascade([documents, chunks], staged(documents.read().filter("doc_id % 10 = 0").select("collection", "doc_id"), "keys"))
    held = documents.read().groupBy("collection").agg(F.count(F.lit(1)).alias("documents"))
    return held.join(chunks.read().groupBy("collection").agg(F.count(F.lit(1)).alias("chunks")), "collection", "full")


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New contents for all documents: some unknown, some read before a change, some equal to another document's; what each has then."""
    documents, _ = _stored(spark, sf_dir)
    rows = documents.read()
    k = F.col("doc_id")
    wanted = F.when(k % 5 == 3, F.concat(F.lit("same for "), F.floor(k / 20).cast("string"))).otherwise(F.concat(F.lit("new "), k.cast("string")))
    asked = rows.select(
        "user_id", "collection", F.when(k % 5 == 1, -k - 1).otherwise(k).alias("doc_id"), F.when(k % 5 == 2, "another").otherwise(F.col("content_hash")).alias("expected_hash"), wanted.alias("content")
    )
    done = updated(documents, staged(asked, "asked"))
    after = documents.read().select("doc_id", F.sha2("content", 256).alias("h"), "content_hash")
    return done.join(after, "doc_id", "left").select("doc_id", "status", "h", (F.col("h") == F.col("content_hash")).alias("agrees"))


def owned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their owner; a file counts where its document still belongs to the user of its folder, which that
    of every fifth no longer does. Types by name, bytes and client, and texts with their encoding."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select((k % 7).alias("user_id"), F.col("source").alias("collection"), "doc_id", "text")
    path = f"{new_folder(spark, 'files')}/files"
    files.write_files(docs, path, "text")
    now = docs.withColumn("user_id", F.when(k % 5 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")))
    found = files.owned_files(spark, path, now, user_id=3)
    told = files.told_text(F.col("content"))
    name = F.concat(F.lit("file."), F.element_at(F.array(*[F.lit(x) for x in ("md", "bin", "weird")]), (k % 3 + 1).cast("int")))
    kind = files.detected_type(name, F.when(k % 3 == 1, F.unhex(F.lit("25504446"))), F.when(k % 2 == 0, "text/x-own").otherwise("application/octet-stream"))
    return found.select("user_id", "collection", "doc_id", F.md5(told["text"]).alias("h"), told["encoding"].alias("encoding"), kind.alias("type"))


QUERIES = {"s14_s3_s2_owned_files": owned_files, "g1_r12_deletions": deletions, "g2_updates": updates, "s5_mail_files": mail_files, "s7_slide_files": slide_files}
ORACLES = {
    "s14_s3_s2_owned_files": """
        SELECT 3::BIGINT AS user_id, source AS collection, doc_id, md5(text || chr(10)) AS h, 'utf-8' AS encoding,
               CASE doc_id % 3 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'application/pdf' ELSE CASE WHEN doc_id % 2 = 0 THEN 'text/x-own' ELSE 'application/octet-stream' END END AS type
        FROM documents WHERE doc_id % 7 = 3 AND doc_id % 5 <> 0""",
    "g1_r12_deletions": """
        WITH d AS (SELECT *, len(string_split(text, chr(10))) AS n, length(source) % 3 AS u FROM documents),
        k AS (SELECT * FROM d WHERE doc_id % 10 <> 0 AND source IS DISTINCT FROM (SELECT min(source) FROM d WHERE u = 1))
        SELECT source AS collection, count(*) AS documents, sum(n)::BIGINT AS chunks FROM k GROUP BY source""",
    "g2_updates": """
        WITH d AS (SELECT *, doc_id % 5 AS t, sha256(text || '#' || doc_id) AS old FROM documents),
        n AS (SELECT *, CASE WHEN t = 3 THEN 'same for ' || doc_id // 20 ELSE 'new ' || doc_id END AS content FROM d),
        s AS (SELECT *, CASE t WHEN 1 THEN 'missing' WHEN 2 THEN 'stale' WHEN 3 THEN
                  CASE WHEN row_number() OVER (PARTITION BY source, content ORDER BY doc_id) = 1 THEN 'updated' ELSE 'duplicate' END ELSE 'updated' END AS status FROM n)
        SELECT CASE WHEN t = 1 THEN -doc_id - 1 ELSE doc_id END AS doc_id, status, CASE status WHEN 'missing' THEN NULL WHEN 'updated' THEN sha256(content) ELSE old END AS h,
               CASE WHEN status <> 'missing' THEN true END AS agrees FROM s""",
    "s5_mail_files": """
        WITH o AS (SELECT *, 'part,customer' || chr(10) || o_orderkey || ',' || o_custkey AS file, o_orderkey % 3 AS t FROM orders)
        SELECT o_orderkey, t <> 0 AS has_plain_text, true AS has_html, CASE WHEN t = 1 THEN '' ELSE 'o' || o_orderkey || '.csv|text/csv|' || length(file) END AS attachments,
               '## Email Headers' || chr(10) || 'From: Shop <shop@example.com>' || chr(10) || 'To: c' || o_custkey || '@example.com' || chr(10) || 'Subject: Grüße ' || o_orderkey || chr(10) || chr(10)
               || '## Email Body' || chr(10) || CASE WHEN t = 0 THEN 'Order ' || o_orderkey || ' & more' ELSE 'Total = ' || o_custkey || ' €, order ' || o_orderkey END || chr(10)
               || CASE WHEN t = 1 THEN '' ELSE chr(10) || '## Attachments' || chr(10) || '- o' || o_orderkey || '.csv (text/csv, 0.0 KB)' || chr(10) || chr(10) || '### Attachment: o' || o_orderkey || '.csv'
                    || chr(10) || file || chr(10) END AS content
        FROM o""",
    "s7_slide_files": """
        WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, l_partkey AS p, l_suppkey AS s FROM lineitem),
        t AS (SELECT l_orderkey, n, p % 50 // 10 AS a, s % 40 AS b, 1 AS c, 0 AS d, 0 AS e, 'Part ' || p AS line FROM li
              UNION ALL SELECT l_orderkey, n, s % 50 // 10, p % 40, 2, p % 30 // 10, s % 20, '  - supplier ' || s FROM li
              UNION ALL SELECT l_orderkey, n, s % 50 // 10, p % 40, 2, s % 30 // 10, p % 20, 'qty: ' || l_quantity::INT || '; ' || l_returnflag FROM li)
        SELECT l_orderkey AS deck, n::INT AS slide, string_agg(line, chr(10) ORDER BY a, b, c, d, e, line LIKE 'qty%') AS content,
               (SELECT 'slide_' || x.n || '_image_' || (x.n - 1) || CASE WHEN x.p % 2 = 0 THEN '.jpeg' ELSE '.png' END FROM li x WHERE x.l_orderkey = t.l_orderkey AND x.n = t.n) AS filename
        FROM t GROUP BY l_orderkey, n""",
}
