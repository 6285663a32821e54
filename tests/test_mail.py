"""Mail parts against the standard library's parser."""

import re
from email import policy
from email.message import EmailMessage
from email.parser import BytesParser

from loomwork.sources.mail import mail_contents, mail_parts


def decoded(data, charset):
    for name in (charset or "utf-8", "utf-8", "latin1"):
        try:
            return data.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue


def stripped(html):
    text = re.sub(r"<(script|style)[^>]*>.*?</\1>", "", html, flags=re.S | re.I)
    text = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", text))
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
        text = text.replace(a, b)
    return text.strip()


def plain(data):
    msg = BytesParser(policy=policy.default).parsebytes(data)
    texts, pages = [], []

    def walk(part):
        kind = part.get_content_type()
        if kind in ("text/plain", "text/html"):
            payload = part.get_payload(decode=True)
            if payload:
                text = decoded(payload, part.get_content_charset())
                (texts if kind == "text/plain" else pages).append(text if kind == "text/plain" else stripped(text))
        elif part.is_multipart() and kind.startswith("multipart"):
            for x in part.iter_parts():
                walk(x)

    walk(msg)
    found = []
    for part in msg.iter_attachments() if msg.is_multipart() else []:
        if "attachment" in part.get("Content-Disposition", "").lower():
            found.append((part.get_filename(), part.get_content_type(), len(part.get_payload(decode=True) or b"")))
    names = ["from", "to", "cc", "subject", "date", "bcc", "reply-to", "message-id", "in-reply-to", "references"]
    heads = [f"{n.title()}: {msg[n]}" for n in names if msg[n]]
    return heads, "\n".join(texts) if texts else "\n".join(pages), found, bool(pages), bool(texts)


def made():
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = "A B <a@b.org>", "c@d.org", "Grüße aus Köln – hello"
    m["Date"], m["Message-ID"] = "Mon, 01 Jan 2024 10:00:00 +0000", "<1@b.org>"
    m.set_content("Plain text with ünïcödé and a very long line " + "x " * 80 + "\n\n-- \nsig = 1\n")
    m.add_alternative("<html><style>p {}</style><body><p>Rich &amp; <b>bold</b></p>\n<script>x</script></body></html>", subtype="html")
    m.add_attachment(b"a,b\n1,2\n", maintype="text", subtype="csv", filename="täble.csv")
    m.add_attachment(bytes(range(256)) * 9, maintype="application", subtype="pdf", filename="x.pdf")
    only_html = EmailMessage()
    only_html["From"], only_html["Subject"] = "x@y.org", "html"
    only_html.set_content("<p>only&nbsp;html</p>", subtype="html", cte="base64")
    latin = EmailMessage()
    latin["From"], latin["To"] = "x@y.org", "z@y.org"
    latin.set_content("café\n", charset="iso-8859-1", cte="quoted-printable")
    inner = EmailMessage()
    inner["Subject"] = "inner"
    inner.set_content("inner text\n")
    inner.add_alternative("<p>inner html</p>", subtype="html")
    outer = EmailMessage()
    outer["Subject"] = "forward"
    outer.set_content("see below\n")
    outer.add_attachment(inner)
    return [m, only_html, latin], outer


RAW = [
    b"Subject: simple\n\nbody line\nmore\n",
    b"Subject: folded\n header line\r\nFrom: a@b\r\n\r\nwith crlf\r\n",
    b"Content-Type: multipart/mixed; boundary=aa\n\npreamble\n--aa\n\nno header\n--aa\nContent-Type: multipart/alternative;\n boundary=\"bb b\"\n\n"
    b"--bb b\nContent-Type: text/plain\n\ninner one\n--bb b\nContent-Type: text/html\n\n<p>two</p>\n--bb b--\nepilogue\n--aa\nContent-Type: text/plain; name=\"n.txt\"\n"
    b"Content-Disposition: attachment; filename=n.txt\n\nfile text\n--aa--\nafter\n",
    b"Content-Type: multipart/mixed; boundary=zz\n\n--zz\nContent-Transfer-Encoding: base64\n\naGVs\nbG8=\n--zz\nContent-Transfer-Encoding: quoted-printable\n\nsoft=\nbreak =3D =C3=A9\n",
    b"Subject: no body\n",
    b"Content-Type: text/plain\n\n--aa is no boundary here\n",
]


def test_against_the_standard_library(spark):
    mails, outer = made()
    data = [*RAW, *(m.as_bytes() for m in mails)]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "id int, raw binary")
    got = {r.id: r for r in mail_contents(df, "id", "raw").collect()}
    for i, d in enumerate(data):
        heads, body, found, has_html, has_plain = plain(d.replace(b"\r\n", b"\n"))
        r = got[i]
        assert (r.has_html, r.has_plain_text) == (has_html, has_plain), i
        assert [tuple(a) for a in r.attachments] == found, i
        want = "\n".join(["## Email Headers", "\n".join(heads), "", "## Email Body", body or "(No text content)", ""])
        assert r.content.startswith(want), (i, r.content[:400], want[:400])
        assert all(f"- {n} ({t}, {s / 1024:.1f} KB)" in r.content for n, t, s in found)


def test_a_forwarded_message_is_one_part(spark):
    _, outer = made()
    df = spark.createDataFrame([(1, bytearray(outer.as_bytes()))], "id int, raw binary")
    parts = mail_parts(df, "id", "raw").orderBy("part").collect()
    assert [p.content_type for p in parts] == ["multipart/mixed", "text/plain", "message/rfc822"]
    assert b"inner text" in bytes(parts[2].payload) and b"inner html" in bytes(parts[2].payload)


def test_odd_files(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"Content-Transfer-Encoding: base64\n\n!!!a"))], "id int, raw binary")
    got = mail_contents(df, "id", "raw").collect()
    assert [r.id for r in got] == [3] and "(No text content)" in got[0].content
    assert mail_contents(df.limit(0), "id", "raw").collect() == []
