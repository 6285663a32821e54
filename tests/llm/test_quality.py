import numpy as np

from loomwork.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = quality.op9_quality(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert (got.held_out == got.doc_id.map(quality.crc_held_out)).all()
    both = got.merge(labels, on="doc_id").query("held_out")
    assert (both.predicted == both.quality).mean() > 0.95
    good = both[both.quality == 1]
    assert (good.predicted == 1).mean() > 0.97
    assert ((got.score >= 0.5).astype(int) == got.predicted).all() and got.score.between(0, 1).all()


def test_coordinate_descent_separates_and_is_bounded():
    rows = [np.array(x, np.uint32) for x in ([1, 2], [1, 3], [4, 5], [4, 6])]
    labels = np.array([1, 1, 0, 0])
    scale = quality.log_count_ratios(rows, labels)
    assert scale[1] > 0 > scale[4]
    w, bias = quality.dual_coordinate_descent(rows, labels, scale)
    margins = [w[x] @ (scale[x] / np.sqrt(scale[x] @ scale[x])) + bias for x in rows]
    assert margins[0] > 0 and margins[1] > 0 and margins[2] < 0 and margins[3] < 0


def test_long_texts_are_read_whole():
    a = "ab" * (quality.PIECE + 10)
    assert set(quality.features(a)) == set(quality.features("ababababab"))
    assert set(quality.features(a + "#")) > set(quality.features(a))


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(0, 0), (1, 0), (2, 1), (3, 1), (5, 1), (9, 0), (9, None), (None, 1)], "doc_id long, quality int"
    )
    got = quality.score_quality(odd_docs, labels)
    rows = got.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert [c for c in odd_docs.columns if c != "score"] == got.columns[:-3]
    assert quality.score_quality(no_docs, labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(odd_docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (4, 1), (6, 1)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in quality.score_quality(odd_docs, one).collect())
    assert quality.keep_good(odd_docs, none).columns == odd_docs.columns


def test_helper_names(spark, clashing_docs, unchanged):
    labels = spark.createDataFrame([(2, 1), (5, 1), (8, 0), (9, 0)], "doc_id long, quality int")
    assert len(unchanged(quality.score_quality(clashing_docs, labels), clashing_docs)) == clashing_docs.count()
    assert quality.keep_good(clashing_docs, labels).columns == clashing_docs.columns


def plain_nbsvm(rows, labels, texts):
    """Dense vectors, log-count ratios, and the dual solved by coordinate descent over the whole Gram matrix."""
    names = sorted({x for r in rows for x in r})
    at = {x: i for i, x in enumerate(names)}
    dense = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        dense[i, [at[x] for x in r]] = 1
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    whole = 1 << quality.BITS
    p, q = (quality.SMOOTHING + dense[y == s].sum(0) for s in (1, -1))
    others = quality.SMOOTHING * (whole - len(names))
    r = np.log((p / (p.sum() + others)) / (q / (q.sum() + others)))
    scaled = dense * r
    scaled /= np.linalg.norm(scaled, axis=1, keepdims=True)
    gram = (scaled @ scaled.T + 1.0) * np.outer(y, y)
    alpha, order = np.zeros(len(rows)), np.random.default_rng(quality.SEED)
    for _ in range(quality.EPOCHS):
        for i in order.permutation(len(rows)):
            alpha[i] = min(max(alpha[i] - (gram[i] @ alpha - 1.0) / 2.0, 0.0), quality.COST)
    w, bias = scaled.T @ (alpha * y), float(alpha @ y)
    w = quality.BLEND * w + (1 - quality.BLEND) * np.abs(w).sum() / whole * np.sign(w)
    out = []
    for t in texts:
        own = [at[x] for x in t if x in at]
        missing = np.log((quality.SMOOTHING / (p.sum() + others)) / (quality.SMOOTHING / (q.sum() + others)))
        norm = np.sqrt((r[own] ** 2).sum() + (len(t) - len(own)) * missing**2)
        margin = 3.0 * (bias + float(r[own] @ w[own]) / max(1e-6, norm))
        out.append(1 / (1 + np.exp(-np.clip(margin, -60, 60))))
    return out


def test_scores_against_a_dense_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    texts = {r.doc_id: quality.features(r.text).tolist() for r in docs.collect()}
    known = sorted((r.doc_id, r.quality) for r in labels.collect() if not quality.crc_held_out(r.doc_id))
    want = plain_nbsvm([texts[i] for i, _ in known], [q for _, q in known], texts.values())
    assert max(abs(got[i] - w) for i, w in zip(texts, want, strict=True)) < 2e-3
