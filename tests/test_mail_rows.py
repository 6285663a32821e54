"""Mails are read inside their row."""

from pyspark.sql import functions as F

from loomwork.sources.mail import mail_contents, mail_parts


def test_no_line_of_a_mail_is_shuffled(spark):
    mails = spark.range(8).repartition(16).select("id", F.encode(F.lit("Subject: a\n\nb"), "UTF-8").alias("raw"))
    for found in (mail_contents(mails, "id", "raw"), mail_parts(mails, "id", "raw")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not [w for w in ("Window", "Join", "hashpartitioning", "Aggregate") if w in plan]


def test_edges_without_lines_and_ended_lists_are_no_parts(spark):
    raw = b"Content-Type: multipart/mixed; boundary=a\n\n--a\n--a\nX: 1\n\n\nbody\n--a--\nend\n--b\n--a\nlast"
    df = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b"--a")), (3, bytearray(b"\n"))], "id int, raw binary")
    got = [(r.id, r.part, r.head, bytes(r.payload)) for r in mail_parts(df, "id", "raw").orderBy("id", "part").collect()]
    assert got == [(1, 0, "Content-Type: multipart/mixed; boundary=a", b""), (1, 2, "X: 1", b"\nbody"), (1, 4, "last", b""), (2, 0, "--a", b""), (3, 0, "", b"")]
