"""Small fixtures with known results for operators that SQL checks only in part."""

from loomwork.operators import fusion, geometry, vector
from loomwork.sources import files
from loomwork.streaming import jobs
from pyspark.sql import functions as F

HITS = "query_id int, id int, score double, rank int"


def fused(spark, a, b, k=None):
    left = spark.createDataFrame([(0, i, s, n + 1) for n, (i, s) in enumerate(a)], HITS)
    right = spark.createDataFrame([(0, i, s, n + 1) for n, (i, s) in enumerate(b)], HITS)
    found = fusion.reciprocal_rank(left, right, "id", k).orderBy("rank").collect()
    return [r.id for r in found], [r.score for r in found]


def test_fusion_orders_by_ranks_and_shows_the_higher_score(spark):
    a, b = [(1, 0.9), (2, 0.8), (3, 0.7)], [(2, 0.95), (3, 0.85), (4, 0.75)]
    assert fused(spark, a, b) == ([2, 3, 1, 4], [0.95, 0.85, 0.9, 0.75])
    assert fused(spark, a, b, 2)[0] == [2, 3]


def test_fusion_of_disjoint_and_empty_lists(spark):
    assert fused(spark, [(1, 0.9), (2, 0.8)], [(3, 0.95), (4, 0.85)])[0] == [1, 3, 2, 4]
    assert fused(spark, [], []) == ([], [])
    assert fused(spark, [(1, 0.9)], [])[0] == [1]


def test_cosine(spark):
    row = spark.range(1).select(
        vector.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0))).alias("same"),
        vector.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(3.0))).alias("right"),
    ).first()
    assert (row.same, row.right) == (1.0, 0.0)


BOXES = "page int, box_id int, score double, x0 double, y0 double, x1 double, y1 double"


def brute_suppressed(boxes, threshold):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[2], b[1])):
        def iou(c):
            w = max(0, min(b[5], c[5]) - max(b[3], c[3]))
            h = max(0, min(b[6], c[6]) - max(b[4], c[4]))
            both = (b[5] - b[3]) * (b[6] - b[4]) + (c[5] - c[3]) * (c[6] - c[4])
            return w * h / (both - w * h + 1e-6)
        if all(iou(c) <= threshold for c in kept):
            kept.append(b)
    return sorted(b[1] for b in kept)


def test_suppression(spark):
    fixed = [(0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (0, 1, 0.8, 1.0, 1.0, 11.0, 11.0), (0, 2, 0.7, 50.0, 50.0, 60.0, 60.0)]
    many = [(1, i, (i * 7 % 13) / 13, float(i * 5 % 17), float(i * 3 % 11), float(i * 5 % 17 + 9), float(i * 3 % 11 + 9)) for i in range(60)]
    found = geometry.suppressed(spark.createDataFrame(fixed + many, BOXES), ["page"], "box_id", 0.5).collect()
    assert sorted(r.box_id for r in found if r.page == 0) == [0, 2]
    assert sorted(r.box_id for r in found if r.page == 1) == brute_suppressed(many, 0.5)
    assert geometry.suppressed(spark.createDataFrame([], BOXES), ["page"], "box_id").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    assert [r.content for r in files.text_files(spark, str(tmp_path)).collect()] == ["one\ntwo\n"]
    probe = spark.createDataFrame([('{"a": 1}\n{"a": 2}\n{"a": 3}',), ('{"a": 1}',), ("plain",), (None,)], "t string")
    found = probe.select(files.json_lines_probe(F.col("t")).alias("x"), files.flat_json(F.col("t")).alias("flat")).collect()
    assert [bool(r.x) for r in found] == [True, False, False, False]
    assert found[1].flat == "a: 1"


def test_status_stream_over_several_batches_equals_the_fold_in_order(spark, tmp_path):
    kinds = ["view", "error", "click", "view", "purchase", "view"]
    rows = [(i, i % 2, kinds[i // 2], f"2024-01-{1 + i:02d} 00:00:00") for i in range(12)]
    schema = "event_id long, user_id long, event_type string, ts string"
    for n in range(3):
        part = spark.createDataFrame(rows[4 * n : 4 * n + 4], schema).withColumn("ts", F.col("ts").cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = jobs.run(jobs.statuses(stream), "update", key=["user_id"]).collect()
    assert sorted(map(tuple, found)) == [(0, "completed", 6), (1, "completed", 6)]


CHUNKS = "id int, document int, chunk_index int, content string, embedding array<double>, metadata string"


def small_corpus(spark):
    from loomwork.operators import graph, retrieve

    words = ["red apples grow on trees", "green apples taste sour", "ships sail the ocean", "an ocean liner ships cargo", "the cargo hold of a ship", "apple growers"]
    rows = [(i, i // 2, i % 2, w, [float("appl" in w), float("ship" in w), 0.1 * i], '{"document_type": "%s"}' % ("book" if i % 2 else "memo")) for i, w in enumerate(words)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    documents = spark.createDataFrame(
        [(0, [1.0, 0.0, 0.05], '{"domain_processor": "book"}'), (1, [0.0, 1.0, 0.25], '{"domain_processor": "memo"}'), (2, [0.5, 0.5, 0.4], '{"domain_processor": "book"}'), (3, None, None)],
        "document int, embedding array<double>, processing_info string",
    )
    docs = spark.createDataFrame([(1, "c", "locomotive factories"), (2, "c", "locomotive factories")], "id int, source string, text string")
    entities, edges = graph.build(docs, "id", "source", "text")
    queries = spark.createDataFrame([(0, "shipping cargo", [0.0, 1.0, 0.0]), (1, "locomotive factories", [1.0, 0.0, 0.0])], "query_id int, query string, query_embedding array<double>")
    return retrieve.Corpus(chunks, documents, entities, edges), queries


def ids_of(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_retrieval_modes(spark):
    import pytest
    from loomwork.operators import retrieve

    corpus, queries = small_corpus(spark)
    hits, refs = retrieve.retrieve(corpus, queries, retrieve.Request(mode="keyword"))
    assert refs is None and ids_of(hits) == {0: [3, 4]} or ids_of(hits) == {0: [4, 3]}  # ships, shipping and ship meet
    hits, _ = retrieve.retrieve(corpus, queries, retrieve.Request(mode="semantic", k=2))
    assert ids_of(hits) == {0: [2, 3], 1: [0, 1]}
    hits, _ = retrieve.retrieve(corpus, queries, retrieve.Request(mode="hybrid", k=2))
    assert len(ids_of(hits)[0]) == 2 and ids_of(hits)[0][0] in (3, 4)
    # The type is a chunk's in the plain modes, and the document's in the two-tier search.
    hits, _ = retrieve.retrieve(corpus, queries, retrieve.Request(mode="semantic", document_type="book"))
    assert set(ids_of(hits)[0]) == {3} and set(ids_of(hits)[1]) == {1, 5}
    hits, _ = retrieve.retrieve(corpus, queries, retrieve.Request(mode="semantic", document_type="book", hierarchical=True))
    assert set(ids_of(hits)[1]) <= {0, 1, 4, 5} and set(ids_of(hits)[1]) >= {0, 1}
    hits, refs = retrieve.retrieve(corpus, queries, retrieve.Request(mode="graph"))
    assert hits.count() == 0 and [(r.query_id, r.a, r.b) for r in refs.collect()] == [(1, "factories", "locomotive")]
    hits, refs = retrieve.retrieve(corpus, queries, retrieve.Request(mode="semantic", k=2, enable_graph=True))
    assert ids_of(hits) == {0: [2, 3], 1: [0, 1]} and refs.count() == 1
    for bad in (retrieve.Request(mode="other"), retrieve.Request(mode="graph")):
        with pytest.raises(ValueError):
            retrieve.retrieve(retrieve.Corpus(corpus.chunks), queries, bad)


def test_windows_come_before_reranking(spark):
    from loomwork.operators import retrieve

    corpus, queries = small_corpus(spark)
    request = retrieve.Request(mode="semantic", k=3, expand_context=True, rerank=retrieve.coverage)
    hits = {(r.query_id, r.id): r for r in retrieve.retrieve(corpus, queries, request)[0].collect()}
    # Chunk 2 has no word about cargo; its window has.
    assert hits[0, 2].rerank_score == 0.5 and "cargo" not in hits[0, 2].content or hits[0, 2].expanded_content
    assert all(r.rerank_score >= 0.3 for r in hits.values())


def test_two_tier_needs_a_text_for_keywords(spark):
    import pytest
    from loomwork.operators import twotier

    corpus, queries = small_corpus(spark)
    for mode in ("keyword", "hybrid"):
        with pytest.raises(ValueError):
            twotier.search(corpus.documents, corpus.chunks, queries.drop("query"), 3, mode)
    with pytest.raises(ValueError):
        twotier.search(corpus.documents, corpus.chunks, queries, 3, "other")
    none = corpus.documents.filter("false")
    assert twotier.search(none, corpus.chunks, queries, 3).count() == 0
    one = twotier.search(corpus.documents, corpus.chunks, queries, 1, multiplier=1)
    assert {(r.query_id, r.document) for r in one.collect()} == {(0, 1), (1, 0)}


def test_stems_and_counts(spark):
    from loomwork.functions import analysis

    words = ["running", "runs", "run", "ships", "shipping", "shipped", "nations", "nation", "add", "adding", "été", "2024s"]
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", analysis.stem(F.col("w")).alias("s")).collect()}
    assert got["running"] == got["runs"] == got["run"] and got["ships"] == got["shipping"] == got["shipped"]
    assert got["nations"] == got["nation"] and got["add"] == got["adding"] == "add"
    assert all(got[w][:3] == w[:3] for w in words)
    rows = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"],)], "t array<string>").select(analysis.counted(F.col("t")).alias("c")).collect()
    assert [[(x.x, x.n) for x in r.c] for r in rows] == [[("a", 1), ("b", 2)], [], [("x", 1)]]


def test_nations_without_customers_count_zero(spark, tmp_path):
    from loomwork.plans import catalog

    spark.createDataFrame([(0, "A"), (1, "B")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(1, 0), (2, 0)], "c_custkey int, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    assert sorted(map(tuple, catalog.counts_per_collection(spark, str(tmp_path)).collect())) == [("A", 2), ("B", 0)]


EVENTS = "event_id long, user_id long, event_type string, ts string"


def streamed(spark, folder, batches):
    """A stream of files, one a batch, in their order."""
    import os
    import time

    for n, rows in enumerate(batches):
        part = spark.createDataFrame(rows, EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        newest = max((e.path for e in os.scandir(f"{folder}/in") if e.name.endswith(".parquet")), key=os.path.getmtime)
        os.utime(newest, (time.time() - 1000 + 10 * n,) * 2)
    return spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_late_rows_don_t_reopen_a_window(spark, tmp_path):
    day = "2024-01-01"
    batches = [
        [(1, 1, "view", f"{day} 00:10:00"), (2, 1, "view", f"{day} 00:20:00")],
        [(3, 1, "view", f"{day} 01:05:00"), (4, 1, "view", f"{day} 00:57:00")],  # late, but before the watermark
        [(5, 1, "view", f"{day} 05:00:00")],
        [(8, 1, "view", f"{day} 05:05:00")],  # late rows are told by the watermark of the batch before
        [(6, 1, "view", f"{day} 00:30:00"), (7, 1, "view", f"{day} 05:10:00")],  # its window is closed: dropped
    ]
    found = jobs.run(jobs.rate_windows(streamed(spark, tmp_path, batches)), "update", key=["user_id", "start"]).collect()
    assert sorted((str(r.start)[11:13], r.calls) for r in found) == [("00", 3), ("01", 1), ("05", 3)]


def test_sessions_are_given_when_closed(spark, tmp_path):
    batches = [
        [(1, 1, "view", "2024-01-01 00:00:00"), (2, 1, "view", "2024-01-01 05:00:00"), (3, 2, "view", "2024-01-01 02:00:00")],
        [(4, 1, "view", "2024-01-04 00:00:00")],
        [(7, 3, "view", "2024-01-04 00:30:00")],
        [(5, 1, "view", "2024-01-01 06:00:00"), (6, 2, "view", "2024-01-04 01:00:00")],
    ]
    found = jobs.run(jobs.sessions(streamed(spark, tmp_path, batches))).collect()
    assert sorted((r.user_id, str(r.start), r.n) for r in found) == [(1, "2024-01-01 00:00:00", 2), (2, "2024-01-01 02:00:00", 1)]


def test_contents_are_known_over_batches(spark, tmp_path):
    for n in range(3):
        part = spark.createDataFrame([(n, "same"), (n + 10, f"own {n}")], "doc_id long, text string")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert jobs.run(jobs.first_contents(stream)).count() == 4


def test_a_cluster_needs_its_shared_folder():
    import pytest
    from types import SimpleNamespace

    from loomwork.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {})
    nothing = SimpleNamespace(sparkContext=context, conf={})
    with pytest.raises(ValueError):
        shared_dir(nothing)


def test_inverted_lists_reach_their_recall(spark):
    from loomwork.operators import ivf
    from loomwork.plans import retrieval

    sf = "/root/testdata/sf0.01"
    exact = retrieval._chunk_hits(spark, sf).select("query_id", "vec_id")
    found = retrieval.indexed_search(spark, sf)
    want, got = ({(r.query_id, r.vec_id) for r in df.select("query_id", "vec_id").collect()} for df in (exact, found))
    assert len(want & got) / len(want) >= 0.9
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    model = ivf.fit(vectors, "vec_id")
    assert ivf.build(vectors, "vec_id", model).count() == vectors.count()
    assert ivf.fit(vectors.filter("false"), "vec_id").centres == []


def test_clustered_vectors_read_few_lists(spark, tmp_path):
    """Recall and the share of rows that a query reads; a list is a folder, and a hot one several files."""
    import numpy as np
    from pyspark.sql import functions as F

    from loomwork.operators import ivf
    from loomwork.operators.vector import top_k_semantic

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    at = np.r_[np.zeros(1500, int), rng.integers(1, 40, 3000)]  # a third in one cluster
    points = centres[at] + rng.normal(scale=0.25, size=(len(at), 16))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(9001, None), (9002, [0.0] * 16)], "id long, embedding array<double>")
    queries = df.filter("id % 50 = 0 and embedding is not null").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    model = ivf.fit(df, "id")
    assert len(model.centres) == 67 and model.probes < 20
    built = ivf.build(df, "id", model)
    index = ivf.write(built, f"file://{tmp_path}/index")
    assert index.count() == 4500
    exact = {(r.query_id, r.id) for r in top_k_semantic(df, queries, "id", 10, None).collect()}
    got = {(r.query_id, r.id) for r in ivf.search(index, queries, "id", model, 10).collect()}
    assert len(exact & got) / len(exact) >= 0.9
    near = F.transform(F.slice(ivf._by_nearness(ivf._unit(F.col("query_embedding")), model.centres), 1, model.probes), lambda s: s["list"])
    sizes = index.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    rows = queries.select("query_id", F.explode(near).alias("list")).join(sizes, "list").agg(F.sum("n")).first()[0]
    assert rows / queries.count() / 4500 < 0.5
    one = index.filter("list = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in one


def plain_merge(levels, size, depth):
    """Line by line: lists of each level's lines from the text upwards, what is held is not begun again."""
    lists = [[i for i, x in enumerate(levels) if x == n] for n in range(size + 1, -1, -1)]
    held, out = set(), []
    for n, own in enumerate(lists[:depth]):
        for j in own:
            if j in held:
                continue
            chain = [j]
            if n != size:
                for higher in lists[n + 1 :]:
                    earlier = [i for i in higher if i < j]
                    if earlier:
                        if earlier[-1] > chain[-1]:
                            chain.pop()
                        chain.append(earlier[-1])
            held.update(chain)
            out.append(chain[::-1])
    return out


def test_merging_under_headings(spark):
    import random

    from loomwork.functions import patterns as P
    from loomwork.operators.merging import hierarchical_merge

    rng, rows, want = random.Random(3), [], {}
    for key in range(30):
        bullet_set = key % len(P.BULLET_SETS)
        size = len(P.BULLET_SETS[bullet_set])
        levels = [rng.randint(0, size + 1) for _ in range(rng.randint(1, 14))]
        rows += [(key, i, f"line {i}", bullet_set, size, x) for i, x in enumerate(levels)]
        want[key] = [[f"line {i}" for i in c] for c in plain_merge(levels, size, 3)]
    df = spark.createDataFrame(rows, "key int, line_no int, line string, bullet_set int, size int, level int")
    got = {}
    for r in sorted(hierarchical_merge(df, "key", 3).collect(), key=lambda r: (r.key, r.at)):
        got.setdefault(r.key, []).append(r.lines)
    assert got == {k: v for k, v in want.items() if v}


def test_zero_vectors_come_last_or_are_not_a_number(spark):
    """Two terms of opposite sign in one place cancel: SQL's similarity is then not a number, first and above any threshold."""
    import math

    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [1.0, 2.0, 3.0]), (5, None)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, query_embedding array<double>")
    shown = lambda **o: [(r.id, "nan" if r.score is not None and math.isnan(r.score) else r.score and round(r.score, 3))
                         for r in vector.top_k_semantic(df, queries, "id", 9, **o).orderBy("rank").collect()]
    assert shown(threshold=None) == [(1, 1.0), (3, 0.707), (2, None), (4, None)]
    assert shown(threshold=0.8) == [(1, 1.0)]
    assert shown(threshold=0.8, nan=True) == [(2, "nan"), (1, 1.0)]
    assert shown(threshold=None, digits=2, nan=True) == [(2, "nan"), (1, 1.0), (3, 0.71), (4, None)]


def test_years_in_names_are_no_dates(spark):
    from loomwork.operators.resumes import job, school

    one = lambda f, text: spark.range(1).select(f(F.lit(text)).alias("x")).first().x
    assert one(job, "Senior Engineer\nAcme 1999\nMay 2010 - Present\nBuilt it").dates == "May 2010 - Present"
    assert one(job, "Senior Engineer\nAcme 12001\nBuilt it").dates is None
    assert one(job, "Senior Engineer, 2001-2005\nAcme").dates == "2001-2005"
    assert one(school, "Major: Field1900, x").dates is None


def test_follow_ups_take_the_last_word(spark):
    from loomwork.functions.text import follow_ups

    row = spark.range(1).select(follow_ups(F.lit("What is one\ntwo "), F.lit("")).alias("a"), follow_ups(F.lit("What is one\ntwo"), F.lit(""), " ").alias("b")).first()
    assert row.a[0].endswith(" to two?") and row.b[0].endswith(" to one\ntwo?")


def test_scores_of_a_block_are_held_in_parts(spark):
    """A block of 2,048 queries against one Arrow batch: a task holds the scores of 64 queries at a time."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    asked = [{"query_id": i, "query_embedding": list(v), "group": ""} for i, v in enumerate(rng.normal(size=(2048, 8)))]
    vectors = rng.normal(size=(4000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(list(vectors)), pa.array([""] * 4000)], names=["id", "vector", "group"])
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    run = vector._nearest(asked, 3, None, schema)
    tracemalloc.start()
    found = pa.Table.from_batches(list(run(iter([batch]))), schema).to_pandas()
    assert tracemalloc.get_traced_memory()[1] < 30 << 20
    tracemalloc.stop()
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    want = np.argsort(-(unit(vectors) @ unit(np.array([q["query_embedding"] for q in asked])).T), axis=0)[:3]
    assert all(set(g["id"]) == set(want[:, q]) for q, g in found.groupby("query_id"))


def test_bands_of_boxes_stay_as_a_fold_has_them(spark):
    """A crowded page, equal scores and boxes that touch the page's cells in every way; no join gives a row for a pair."""
    import random

    rng, rows = random.Random(5), []
    for i in range(1500):
        x, y = rng.randint(-50, 350), rng.randint(-50, 350)
        rows.append((i % 3 // 2, i, rng.randint(1, 40) / 40, float(x), float(y), float(x + rng.randint(-2, 130)), float(y + rng.randint(30, 130))))
    boxes = spark.createDataFrame(rows, BOXES)
    want = {(r.page, r.box_id) for r in geometry.suppressed(boxes, ["page"], "box_id").collect()}
    found = geometry.suppressed_in_bands(boxes, ["page"], "box_id", band=40)
    assert [(r.page, r.box_id) for r in found.select("page", "box_id").orderBy("page", "box_id").collect()] == sorted(want)
    assert geometry.suppressed_in_bands(boxes.limit(0), ["page"], "box_id").count() == 0


def test_indexed_search_in_blocks_is_exact_with_all_lists(spark, tmp_path, monkeypatch):
    """Blocks of few queries, hot lists in parts, copies that tie at the edge, other lengths: with all lists read, brute force."""
    import numpy as np
    from pyspark.sql import functions as F

    from loomwork.operators import ivf

    monkeypatch.setattr(ivf, "ASKED", 16)
    rng = np.random.default_rng(8)
    points = np.r_[np.repeat(rng.normal(size=(1, 8)), 120, axis=0), rng.normal(size=(180, 8))]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(901, [1.0]), (902, [float("nan")] * 8)], "id long, embedding array<double>")
    queries = df.filter("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    model = ivf.fit(df.filter("id < 900"), "id", lists=6)
    index = ivf.write(ivf.build(df, "id", model), f"file://{tmp_path}/index")
    hits = ivf.search(index, queries, "id", model, 4, probes=6).collect()
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    want = {(q, int(i)) for q in range(0, 300, 5) for i in np.lexsort((np.arange(300), -scores[q]))[:4]}
    assert {(r.query_id, r.id) for r in hits} == want
    assert len(ivf._blocks([(0, 40), (1, 10), (2, 6), (3, 1)])) == 5  # three parts of the hot list, then [1, 2] and [3]


def test_tables_inside_their_row_are_those_of_lines(spark):
    """Values of random texts with short rows, several tables, late rules and none; no exchange in the plan."""
    import random

    from loomwork.operators import structure as S

    rng = random.Random(5)
    cells = ["a", "12", "name of it", "x (1)", "", "-", "Y", "0x1f", "größe", " | "]
    line = lambda: rng.choice(["text", "", "| only", "|---|:-:|", "  |--|--|  "] + ["|" + "|".join(rng.choices(cells, k=rng.randint(1, 4))) + rng.choice(["|", "| tail", ""]) for _ in range(9)])
    docs = spark.createDataFrame([(i, "\n".join(line() for _ in range(rng.randint(0, 25)))) for i in range(400)] + [(900, None), (901, "")], "id long, text string")
    want = S.table_values(S.tables(S.explode_lines(docs, "id"), "id"), "id")
    got = S.block_values(S.table_blocks(docs, "id"), "id").select(*want.columns)
    assert got.count() == want.count() > 500
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert "Exchange" not in S.block_values(S.table_blocks(spark.range(3).selectExpr("id", "'x' text"), "id"), "id")._jdf.queryExecution().executedPlan().toString()


def test_shapes_of_slides_are_made_once(spark):
    """However many levels of groups there are, what makes the shapes runs once; a group's picture is no text, an orphan is nowhere."""
    from pyspark.sql import functions as F

    from loomwork.sources import slides

    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    rows = [(1, 1, 1, None, 0, "group"), (1, 1, 2, 1, 1, "group"), (1, 1, 3, 2, 2, "text"), (1, 1, 4, 2, 3, "picture"), (1, 2, 5, None, 0, "picture"), (1, 3, 6, 99, 0, "text"), (1, 1, 7, None, 4, "text")]
    shapes = spark.createDataFrame(rows, "deck long, slide int, shape_id long, parent_id long, seq int, kind string")
    para = F.array(F.struct(F.concat(F.lit("t"), F.col("shape_id").cast("string")).alias("text"), F.lit(0).alias("level"), F.lit(False).alias("bullet")))
    none = F.lit(None)
    shapes = shapes.withColumn("slide", F.udf(seen, "int")("slide")).select(
        "*", none.cast("double").alias("top"), none.cast("double").alias("left"), para.alias("paragraphs"), none.cast("array<array<string>>").alias("cells"), none.cast("string").alias("media_type")
    )
    assert {(r.slide, r.content) for r in slides.slide_texts(shapes).collect()} == {(1, "t3\nt7"), (2, "")}
    assert made.value <= len(rows)


def test_cell_kinds_look_at_distinct_cells(spark):
    """Cells are counted before they are looked at: two counts, of which the first is by the cell."""
    from loomwork.plans import text

    plan = text.cell_kinds(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and "Aggregate [cell" in plan


def test_sources_search_once(spark, monkeypatch):
    from loomwork.operators import lexical
    from loomwork.plans import retrieval

    calls, search = [], lexical.keyword_search
    monkeypatch.setattr(lexical, "keyword_search", lambda *a, **b: calls.append(1) or search(*a, **b))
    retrieval.sources(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
