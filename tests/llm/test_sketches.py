import hashlib

from pyspark.sql import functions as F

from loomwork.llm import sketches
from loomwork.llm._common import range_of

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    out = {}
    for (d, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        out[d] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), shingles(text), shingles(edited), shingles(after))
    return out


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_exact_sets(spark):
    want = plain([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    errors = []
    for r in sketches.op4_fingerprints(spark, SF).collect():
        n, sha, own, edited, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        errors.append(abs(r.near_edited - like(own, edited)))
        assert abs(r.near_next - like(own, after)) < 0.25
        # A quarter of the shingles is kept, so large sketches lie near a quarter of the set.
        if len(own) > 400:
            assert 0.15 < len(r.fingerprint) / 16 / len(own) < 0.35
    assert sum(errors) / len(errors) < 0.08


def test_union_and_containment(spark):
    rows = [("a " * 3 + " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(1000, 1400)))]
    df = spark.createDataFrame(rows, "x string, y string")
    df = sketches.with_sketch(sketches.with_sketch(df, F.col("x"), "sx"), F.col("y"), "sy")
    df = sketches.with_sketch(df, F.concat("x", F.lit(" "), "y"), "sxy")
    r = df.select(
        sketches.containment(F.col("sx"), F.col("sy")).alias("c"),
        sketches.resemblance(F.col("sx"), F.col("sy")).alias("r"),
        F.size(F.array_except(sketches.merged(F.col("sx"), F.col("sy")), "sxy")).alias("lost"),
    ).first()
    assert r.c == 1.0 and r.r < 0.2 and r.lost == 0


def test_merging_is_the_sketch_of_both(spark):
    """Two stand-ins of every sign, stand-in and regular, regular and empty; other fractions as well."""
    low, high, regular = (1 << 62) + 7, (1 << 63) - 9, 5
    pairs = [([-5], [low]), ([low], [high]), ([-5], [-9]), ([-5], [-5]), ([low], []), ([], [-1]), ([], []), ([regular], [low]), ([-3], [regular]), ([2, 7], [regular])]
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    for r in df.select("a", "b", sketches.merged(F.col("a"), F.col("b")).alias("m")).collect():
        both = {*r.a, *r.b}
        kept = sorted(h for h in both if 0 <= h < 1 << 62)
        assert r.m == (kept or sorted(both, key=lambda h: h % (1 << 64))[:1])
    texts = [(f"word{i} of text", f"another{i}") for i in range(60)] + [(f"w{i} " * 3 + "a b c d e f", "x y z") for i in range(20)]
    both = spark.createDataFrame(texts, "x string, y string")
    for bits in (1, 2, 6):
        df = both
        for c in ("x", "y"):
            df = sketches.with_sketch(df, F.col(c), f"s{c}", bits)
        for r in df.select("x", "y", "sx", "sy", sketches.merged(F.col("sx"), F.col("sy"), bits).alias("m")).collect():
            union = {*r.sx, *r.sy}
            kept = sorted(h for h in union if 0 <= h < 1 << (64 - bits))
            assert r.m == (kept or sorted(union, key=lambda h: h % (1 << 64))[:1])


def test_a_hot_id_fills_several_ranges(spark):
    rows = [(7 if i % 3 else i, f"text number {i} " + "w " * (i % 50)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sketches.with_next(docs, ["text"]).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows)
    # Every row is the next of one other: the pairs make one round of all rows, in descending order of ids.
    after = {(r.doc_id, r.text): r.next_text for r in got}
    assert sorted(after.values()) == sorted(t for _, t in rows)
    ids = {t: d for d, t in rows}
    assert sum(ids[r.next_text] > r.doc_id for r in got) == 1


def test_range_search(spark):
    cuts = [3, 3, 10, 20, 50]
    got = spark.range(60).select("id", range_of(F.col("id"), sorted(set(cuts))).alias("r")).collect()
    assert all(r.r == sum(c <= r.id for c in {3, 10, 20, 50}) for r in got)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = sketches.with_next(sketches.with_sketch(docs, F.col("text"), "sketch"), ["text", "sketch"]).collect()
    assert len(got) == odd_docs.count()
    assert all((len(r.sketch) == 0) == (not r.text.split()) for r in got)
    by = {}
    for r in got:
        assert by.setdefault(r.text, r.sketch) == r.sketch
    ids = sorted({(r.doc_id is not None, r.doc_id or 0) for r in got}, reverse=True)
    texts = {}
    for r in got:
        texts.setdefault((r.doc_id is not None, r.doc_id or 0), []).append(r.text)
    after = {a: {*texts[a], *texts[b]} for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}
    assert all(r.next_text in after[(r.doc_id is not None, r.doc_id or 0)] for r in got)
    assert sorted(r.next_text for r in got) == sorted(r.text for r in got)
    assert sketches.with_next(sketches.with_sketch(no_docs, F.col("text"), "sketch"), ["text", "sketch"]).count() == 0
    one = docs.filter("doc_id = 2").limit(1)
    assert sketches.with_next(one, ["text"]).first().next_text == one.first().text


def test_helper_names(clashing_docs, unchanged):
    docs = clashing_docs.withColumn("text", F.coalesce("text", F.lit("")))
    got = sketches.with_next(sketches.with_sketch(docs, F.col("text"), "sketch"), ["text", "sketch"])
    assert len(unchanged(got, clashing_docs)) == docs.count()


def test_ranges_follow_bytes(spark):
    """One very long text among short ones: it shares its range with few others, and pairs stay right."""
    rows = [(i, "w " * (40_000 if i == 50 else 5)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: len(r.next_text) for r in sketches.with_next(docs, ["text"]).collect()}
    assert all(got[i] == len(rows[(i - 1) % 400][1]) for i in range(400))
