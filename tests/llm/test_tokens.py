import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomwork.llm import packing, token_files, tokens
from loomwork.llm._common import new_folder, tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = [
    "", "a", "don't I'LL we've 12 345 ²½", "  two  spaces \n\n\n x\t", "İstanbul ΣΑΣ", "<|endoftext|> hi <|endoftext|>",
    "<|startoftext|>abc", "é", "naïve — “q” 日本語 🙂", "\x1c\x1f a\x85b\xa0c \x00d", "x" * 5000, "ﬁ Å Ω ", "\r\n a \r\n",
    "'s'S 'T", "ª º µ ǅ", "a b", "0 0  0   0", " ", "\n", "é",
]


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_encoder_gives_the_library_ids(spark, name):
    library = Tokenizer.from_file(tokenizer_path(name))
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text, ids in zip(texts, tokens.Encoder(tokenizer_path(name)).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    library = Tokenizer.from_file(tokenizer_path(tokens.BYTE_BPE))
    texts = [" ".join(f"w{i * j}" for j in range(5)) for i in range(20)] * 2
    for text, ids in zip(texts, tokens.Encoder(tokenizer_path(tokens.BYTE_BPE)).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_counts_and_cache(spark, odd_docs, no_docs):
    path, cache = tokenizer_path(tokens.BYTE_BPE), new_folder(spark, "cache-test")
    library = Tokenizer.from_file(path)
    rows = tokens.count_tokens(odd_docs, cache, path).collect()
    texts = [r.text or "" for r in odd_docs.collect()]
    want = sorted((len(t.encode()), len(library.encode(t).ids)) for t in texts)
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    stored = spark.read.parquet(cache)
    assert stored.count() == len(set(texts))
    # A second call finds every content in the cache, and uses what is stored there.
    spark.createDataFrame([("x", "y", 1)], tokens.CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache)
    files = set(spark.read.parquet(cache).inputFiles())
    tokens.count_tokens(odd_docs, cache, path).collect()
    assert spark.read.parquet(cache).count() == len(set(texts)) + 1
    # Nothing was missing, so no file came; only the folder of the tokenizer is read.
    assert set(spark.read.parquet(cache).inputFiles()) == files
    plan = tokens._stored(spark, cache, "y")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tokenizer" in plan
    assert tokens.count_tokens(no_docs, cache, path).count() == 0


def test_a_warm_cache_is_hit(spark):
    """A second run of the query encodes nothing, and gives the same rows."""
    cache = new_folder(spark, "cache-test")
    spark.conf.set(tokens.CACHE_SETTING, cache)
    try:
        first = sorted(map(tuple, tokens.op6_token_counts(spark, SF).collect()))
        stored = spark.read.parquet(cache)
        n, contents = stored.count(), spark.read.parquet(f"{SF}/documents.parquet").select("text").distinct().count()
        assert n == contents
        assert sorted(map(tuple, tokens.op6_token_counts(spark, SF).collect())) == first
        assert spark.read.parquet(cache).count() == n
    finally:
        spark.conf.unset(tokens.CACHE_SETTING)


def test_normal_forms_share_a_count(spark):
    path = tokenizer_path(tokens.WORD_BPE)
    library = Tokenizer.from_file(path)
    texts = ["Hello  World", "hello world\n", " hello\tWORLD", "<|ENDOFTEXT|> a", "<|endoftext|> a", "J\u030c x", "j\u030c x", "ÀB", None, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cache = new_folder(spark, "cache-test")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, cache, path).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert spark.read.parquet(cache).count() == 7  # three ways of one text, and null beside white space


def test_token_files(spark, odd_docs, no_docs):
    path = tokenizer_path(tokens.WORD_BPE)
    library = Tokenizer.from_file(path)

    def ids(text):
        return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")

    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        folder = new_folder(spark, "files-test")
        token_files.write_token_files(docs, folder, path)
        got = token_files.read_token_files(spark, folder).collect()
        rows = docs.collect()
        assert len(got) == len(rows)
        key = lambda d: (d is not None, d or 0)
        want = sorted((key(r.doc_id), zlib.crc32(ids(r.text).tobytes())) for r in rows)
        assert sorted((key(r.doc_id), r.ids_crc32) for r in got) == want
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        assert [key(r.doc_id) for r in sorted(got, key=lambda r: r.start)] == [w[0] for w in want]
    some = spark.createDataFrame([(3,), (77,), (10**12,)], "doc_id long")
    found = token_files.lookup(spark, folder, some).collect()
    texts = {r.doc_id: r.text for r in rows}
    assert {r.doc_id: r.ids for r in found} == {i: ids(texts[i]).tolist() for i in (3, 77)}
    one = token_files.fetch(spark, folder, 77)
    assert [(r.doc_id, r.ids) for r in one.collect()] == [(77, ids(texts[77]).tolist())]
    assert token_files.fetch(spark, folder, 10**12).count() == 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan) and "LessThanOrEqual(first_key,77)" in plan
    assert "keys" not in plan.split("ReadSchema")[1]
    folder = new_folder(spark, "files-test")
    token_files.write_token_files(no_docs, folder, path)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_shards_are_row_groups_and_hot_keys_are_split(spark, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(token_files, "SHARD_DOCS", 16)
    rows = [(i if i % 3 else 7, f"text number {i} of many") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = new_folder(spark, "files-test")
    token_files.write_token_files(docs, folder, tokenizer_path(tokens.WORD_BPE))
    table = spark.read.schema(token_files.SHARDS).parquet(folder)
    hot = table.filter("first_key <= 7 and last_key >= 7")
    assert hot.count() > 10 and hot.select("part").distinct().count() > 1
    files = [f.removeprefix("file:").lstrip("/") for f in table.inputFiles()]
    assert sum(pq.ParquetFile("/" + f).num_row_groups for f in files) == table.count()
    # One row group is read for a key that isn't hot, although its range has many.
    key = next(i for i in range(590, 0, -1) if i % 3)
    held = table.filter(f"first_key <= {key} and last_key >= {key}").collect()
    assert len(held) == 1 and token_files.fetch(spark, folder, key).count() == 1
    assert token_files.fetch(spark, folder, 7).count() == sum(r[0] == 7 for r in rows)
    asked = spark.createDataFrame([(7,), (key,), (None,), (-5,)], "doc_id long")
    found = token_files.lookup(spark, folder, asked).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in found} == {7: sum(r[0] == 7 for r in rows), key: 1}
    got = token_files.read_token_files(spark, folder).collect()
    assert len(got) == 600 and sorted(r.start for r in got)[0] == 0


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 4096])
def test_index_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
    _, slots = token_files.build_index(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    records = [np.array([i], "<u2").tobytes() for i in range(len(keys))]
    _, blob = token_files.write_shard(keys.tolist(), records, 2)
    shard = token_files.Shard(blob)
    for i, slot in enumerate(shard.find(keys).tolist()):
        assert [x.tolist() for _, x in shard.records(slot)] == [[i % 65536]]
    foreign = np.arange(1, 20_001, dtype=np.int64) | (1 << 62)
    assert (shard.find(foreign) >= 0).mean() < 0.001


def test_packing_places_every_token_once(spark, odd_docs, no_docs):
    path = tokenizer_path(tokens.BYTE_BPE)
    library = Tokenizer.from_file(path)
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = packing.pack_documents(docs, path).toPandas()
        want = []
        for r in docs.collect():
            ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            n = len(ids)
            cuts = [0, n] if n <= 2048 else [0, *range(n % 2048 or 2048, n + 1, 2048)]
            for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                want.append((-1 if r.doc_id is None else r.doc_id, p, a, b - a, zlib.crc32(ids[a:b].tobytes())))
        rows = got[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype("int64")
        assert sorted(map(tuple, rows.to_numpy().tolist())) == sorted(want)
        for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
            assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 2048
        assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert packing.pack_documents(no_docs, path).count() == 0


def test_genetic_operators_keep_every_item():
    rng = np.random.default_rng(3)
    size = rng.integers(200, 1200, 120)
    start = packing.best_fit(list(range(120)), size.tolist(), [], [], 2048)
    other = packing.best_fit(np.argsort(-size).tolist(), size.tolist(), [], [], 2048)
    for seed in range(20):
        child = packing.crossover(start, other, size.tolist(), 2048, 0.4, np.random.default_rng(seed))
        assert sorted(i for b in child.bins for i in b) == list(range(120))
        assert [2048 - sum(size[i] for i in b) for b in child.bins] == child.left and min(child.left) >= 0
    evolved = packing.evolve(size, [], 1)
    fill = np.bincount(evolved, weights=size)
    assert fill.max() <= 2048 and len(fill) <= len(other.bins)


def test_later_rounds_and_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 40)
    from pyspark.sql import functions as F

    items = spark.range(700).select(F.col("id").alias("uid"), (F.pmod(F.xxhash64("id"), F.lit(1500)) + 1).alias("length"))
    got = packing.pack(items, 2048).toPandas()
    assert sorted(got.uid) == list(range(700))
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 2048


def brute_fewest(size, capacity):
    """The least number of bins, by trying every bin for every item."""
    best = len(size)

    def put(i, left):
        nonlocal best
        if len(left) >= best:
            return
        if i == len(size):
            best = len(left)
            return
        for b in range(len(left)):
            if left[b] >= size[i]:
                left[b] -= size[i]
                put(i + 1, left)
                left[b] += size[i]
        put(i + 1, [*left, capacity - size[i]])

    put(0, [])
    return best


def test_small_shards_reach_the_optimum():
    rng = np.random.default_rng(11)
    for seed in range(15):
        size = rng.integers(20, 70, 9)
        want = brute_fewest(sorted(size.tolist(), reverse=True), 100)
        assert packing.fewest(size, 100) <= want
        assert packing.evolve(size, [], seed, 100).max() + 1 == want


def test_evolution_beats_its_own_start():
    """Where best-fit decreasing leaves slack, the packings that evolve from it need fewer bins."""
    size = np.random.default_rng(4).integers(300, 1000, 2000)
    start = packing.best_fit(np.argsort(-size, kind="stable").tolist(), size.tolist(), [], [], 2048)
    evolved = packing.evolve(size, [], 5)
    assert len(start.bins) > packing.fewest(size, 2048)
    assert evolved.max() + 1 <= 0.985 * len(start.bins)
    again = packing.evolve(size, [evolved, packing.evolve(size, [], 6)], 7)
    assert again.max() <= evolved.max()


def test_sequences_of_the_query_are_near_the_bound(spark):
    got = packing.op10_best_fit_packing(spark, "/root/testdata/sf0.1").toPandas()
    assert got.sequence_id.nunique() <= 1.01 * -(-got.length.sum() // 2048)
    assert got.groupby("sequence_id").length.sum().max() <= 2048
