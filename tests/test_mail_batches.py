"""Mails are read in Arrow batches: odd bytes in headers and names, large mails, shortcuts against plain definitions."""

import random
import re

from pyspark.sql import functions as F

from loomwork.sources import mail
from loomwork.sources.mail import mail_contents, mail_parts


def test_a_line_ends_at_cr_and_lf_alone(spark):
    """0x85 is a byte of many letters, no line end: "Å" in a header is whole and begins no header line."""
    raw = "Subject: Ångström\nX: Åto: nobody\n\nbody".encode()
    got = mail_contents(spark.createDataFrame([(1, bytearray(raw))], "id int, raw binary"), "id", "raw").collect()
    assert [r.content for r in got] == ["## Email Headers\nSubject: Ångström\n\n## Email Body\nbody\n"]


def test_names_with_a_charset_of_their_own_are_decoded_once(spark):
    raw = b"Content-Type: multipart/mixed; boundary=a\n\n--a\nContent-Disposition: attachment; filename*=utf-8''%E2%82%AC%20%C3%83%C2%A4.csv\nContent-Type: text/csv\n\nx\n--a--\n"
    got = mail_contents(spark.createDataFrame([(1, bytearray(raw))], "id int, raw binary"), "id", "raw").collect()
    assert [tuple(a) for a in got[0].attachments] == [("€ Ã¤.csv", "text/csv", 1)]


def test_mails_are_no_column_expressions(spark):
    mails = spark.range(8).select("id", F.encode(F.lit("Subject: a\n\nb"), "UTF-8").alias("raw"))
    for found in (mail_contents(mails, "id", "raw"), mail_parts(mails, "id", "raw")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "transform(" not in plan and "regexp" not in plan


def test_large_mails_come_in_pieces(spark):
    text = F.concat(F.lit("Subject: "), F.col("id").cast("string"), F.lit("\n\n"), F.repeat(F.lit("x"), 9 << 20))
    mails = spark.range(5).coalesce(1).select("id", F.encode(text, "UTF-8").alias("raw"))
    got = mail_contents(mails, "id", "raw").select("id", F.length("content").alias("n"), F.substring("content", 1, 45).alias("c")).orderBy("id").collect()
    heads = [f"## Email Headers\nSubject: {i}\n\n## Email Body\n" for i in range(5)]
    assert [(r.id, r.c[: len(h)], r.n) for r, h in zip(got, heads, strict=True)] == [(i, h, len(h) + (9 << 20) + 1) for i, h in enumerate(heads)]


def test_quoted_printable_by_its_definition():
    rng = random.Random(3)
    for _ in range(20_000):
        data = b"".join(rng.choice([b"=", b"=", b"4", b"F", b"f", b"g", b" ", b"\t", b"\n", b"_", b"=C3"]) for _ in range(rng.randint(0, 9)))
        for word in (False, True):
            want = re.sub(rb"=[ \t]*\n", b"", data)
            want = want.replace(b"_", b" ") if word else re.sub(rb"(?m)[ \t]+$", b"", want)
            want = re.sub(rb"=([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), want)
            assert mail.quoted_printable(data, word) == want, data
