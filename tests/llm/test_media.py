import hashlib
import zlib

import numpy as np

from loomwork.llm import flac, media

SF = "/root/testdata/sf0.001"


def padded(data):
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def payloads():
    rng = np.random.default_rng(1)
    wave = (127 * np.sin(np.arange(9000) / 40) + 128).astype(np.uint8)
    return [
        padded(b""), padded(b"a"), padded(b"a" * 3000), padded(rng.bytes(5000)), padded(bytes(range(256)) * 40),
        padded(wave.tobytes()), padded(rng.integers(0, 256, 3000).cumsum().astype(np.uint8).tobytes()),
        padded("Ünïcödé 日本語 🙂 text ".encode() * 400), padded(b"plain words and more of them " * 500),
    ]


def test_round_trip_of_all_kinds():
    data = payloads()
    streams = list(flac.encode(data))
    kinds = set()
    for s in streams:
        for start, _, head, _ in flac.frames_of(s)[0]:
            code = s[start + head] >> 1
            kinds.add("linear" if code >= 32 else "fixed" if code >= 8 else code)
    assert {0, 1, "fixed", "linear"} <= kinds
    for payload, (blocks, offsets, wrong) in zip(data, flac.decode(streams), strict=True):
        assert wrong is None and b"".join(blocks) == payload
        for block, at in zip(blocks, offsets, strict=True):
            assert payload[at : at + len(block)] == block


def test_damage_is_reported_and_stays_in_its_stream():
    streams = list(flac.encode(payloads()))
    bad = bytearray(streams[3])
    bad[len(bad) // 2] ^= 4
    got = list(flac.decode([bytes(bad), streams[4], b"", b"no stream at all", streams[5][:-40]]))
    assert [x[2] is None for x in got] == [False, True, False, False, False]
    assert all(not x[0] for i, x in enumerate(got) if i != 1)


def test_frames_are_found_without_a_seek_table():
    for payload in payloads():
        s = next(iter(flac.encode([payload])))
        at = 42  # behind the stream info
        size = int.from_bytes(s[at + 1 : at + 4], "big")
        bare = s[:4] + b"\x80" + s[5:at] + s[at + 4 + size :]  # the block before the table is the last one now
        blocks, _, wrong = next(iter(flac.decode([bare])))
        assert wrong is None and b"".join(blocks) == payload


def test_a_public_stream():
    """The example of RFC 9639 with a linear predictor and an escaped partition; its MD5 is in the stream."""
    stream = bytes.fromhex(
        "664c6143800000221000100000001f00001f07d0007000000018f8f9e396f5cbcfc6dc807f9977906b32"
        "fff868020017e944004f6f313d1047d227cb6d090831452bdc2822228057a3"
    )
    blocks, offsets, wrong = next(iter(flac.decode([stream])))
    assert wrong is None and offsets == [0]
    signed = bytes(x ^ 0x80 for x in blocks[0])
    assert hashlib.md5(signed).hexdigest() == "f8f9e396f5cbcfc6dc807f9977906b32"
    assert [x - 128 for x in blocks[0][:4]] == [0, 79, 111, 78]


def test_samples_are_bytes_less_128():
    for payload in payloads():
        s = next(iter(flac.encode([payload])))
        assert s[26:42] == hashlib.md5(bytes(x ^ 0x80 for x in payload)).digest()
        blocks, _, wrong = next(iter(flac.decode([s])))
        assert wrong is None and b"".join(blocks) == payload


def test_checksums_and_numbers():
    assert flac.crc16(b"123456789") == 0xFEE8 and flac.crc8(b"123456789") == 0xF4
    data = [b"123456789", b"", b"x" * 1000]
    assert flac.crc16_of(data).tolist() == [flac.crc16(x) for x in data]
    for n in (0, 127, 128, 0x7FF, 0x800, 0xFFFF, 0x10000, (1 << 31) - 1):
        head = flac._header(n, 64) + bytes(4)
        assert flac._parse_header(head, 0)[:2] == (n, 64)


def test_query_against_plain_digests(spark):
    got = {r.doc_id: r for r in media.op2_flac_media(spark, SF).collect()}
    seen = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        data, x = padded((r.text or "").encode()), got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes) == (len((r.text or "").encode()), len(data))
        assert x.payload_sha256 == hashlib.sha256(data).hexdigest() and x.tail_crc32 == zlib.crc32(data[-64:])
        assert seen.setdefault(r.text, (x.media_sha256, x.feature)) == (x.media_sha256, x.feature)


def test_samples_by_offset(spark, odd_docs):
    from pyspark.sql import functions as F

    pcm = media.decode_media(media.encode_media(odd_docs)).filter("doc_id = 5")
    text = odd_docs.filter("doc_id = 5").first().text.encode()
    for start, n in ((0, 10), (2040, 20), (2048, 2048), (100_000, 5000), (len(text) - 3, 3)):
        assert bytes(pcm.select(media.samples(pcm, start, n).alias("x")).first().x) == text[start : start + n]
    assert pcm.select(F.size("blocks")).first()[0] == -(-(-(-len(text) // 64) * 64) // flac.BLOCK)


def test_odd_rows(spark, odd_docs, no_docs):
    streams = media.encode_media(odd_docs)
    rows = media.payload_digests(media.decode_media(streams)).collect()
    assert len(rows) == odd_docs.count() and all(r.error is None for r in rows)
    assert {r.payload_bytes for r in rows if not r.n_bytes} == {64}
    blocks = media.decode_media(streams).filter("doc_id = 5").first().blocks
    assert [b.sample_offset for b in blocks] == [i * flac.BLOCK for i in range(len(blocks))]
    none = media.encode_media(no_docs)
    assert media.payload_digests(media.decode_media(none)).count() == 0 and media.decode_media(none).count() == 0
    damaged = streams.filter("doc_id = 5").selectExpr("doc_id", "n_bytes", "substring(media, 1, 900) as media")
    bad = media.payload_digests(media.decode_media(damaged)).first()
    assert bad.error and bad.payload_sha256 is None
