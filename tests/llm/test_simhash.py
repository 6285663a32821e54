import random

import numpy as np
import xxhash

from loomwork.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, bits=4):
    group = list(range(len(prints)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                group[find(i)] = find(j)
    least = {}
    for i, d in zip(range(len(ids)), ids, strict=True):
        least.setdefault(find(i), []).append(d)
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = simhash.op8_simhash_groups(spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id")
    rows = docs.orderBy("doc_id").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert got.component_id.tolist() == plain_components([r.doc_id for r in rows], prints)


def test_dense_and_chained_fingerprints(spark):
    """Groups of fingerprints around random centres, at all distances near the limit, and chains of them."""
    rng = random.Random(5)
    prints = [0, (1 << 64) - 1]
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            prints.append(x)
        for _ in range(8):
            for b in rng.sample(range(64), 4):
                centre ^= 1 << b
            prints.append(centre)
    prints = list(dict.fromkeys(prints))
    ids = rng.sample(range(10_000), len(prints))
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    nodes = spark.createDataFrame(list(zip(signed, ids, strict=True)), "fp long, node long")
    links = {tuple(sorted(r)) for r in simhash.near_links(nodes).collect()}
    want = {
        tuple(sorted((ids[i], ids[j])))
        for i in range(len(ids))
        for j in range(i)
        if (prints[i] ^ prints[j]).bit_count() <= 4
    }
    assert links == want
    by_halves = [tuple(sorted(r)) for r in simhash.near_links(nodes, halves=True).collect()]
    assert set(by_halves) == want and len(by_halves) <= 2 * len(want)  # once in each half that is close
    parts = {tuple(sorted(r)) for r in simhash.neighbour_links(nodes, dense=8).collect()}
    assert parts <= want
    some = {tuple(sorted(r)) for r in simhash.neighbour_links(nodes).collect()}
    assert some <= want
    got = {r.node: r.component for r in simhash.components(simhash.near_links(nodes)).collect()}
    assert [got.get(i, i) for i in ids] == plain_components(ids, prints)


def test_odd_rows(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[0].fp == 0 and by_id[0].component_id == by_id[1].component_id == by_id[7].component_id == 0
    assert by_id[2].component_id == by_id[3].component_id == by_id[4].component_id == 2
    kept = simhash.one_of_each_group(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 2 in ids and 3 not in ids and 4 not in ids
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each_group(no_docs).count() == 0


def test_helper_names(clashing_docs, unchanged):
    kept = simhash.one_of_each_group(clashing_docs)
    assert kept.columns == clashing_docs.columns
    unchanged(kept, clashing_docs)


def test_a_dense_group_is_joined_before_pairs_are_made(spark):
    """2,000 fingerprints around one centre: the links of neighbours leave few nodes, and few links to emit."""
    rng = random.Random(9)
    centre, prints = rng.getrandbits(64), set()
    while len(prints) < 2000:
        prints.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = sorted(int(np.uint64(p).view(np.int64)) for p in prints)
    nodes = spark.createDataFrame(list(zip(signed, range(len(signed)), strict=True)), "fp long, node long").repartition(4)
    first = simhash.components(simhash.neighbour_links(nodes), "dense-test")
    from pyspark.sql import functions as F

    joined = nodes.join(first, "node", "left").select("fp", F.coalesce("component", "node").alias("node"))
    left = joined.select("node").distinct().count()
    emitted = simhash.near_links(joined).count()
    assert left < len(prints) / 10 and emitted < 2000 * 1999 / 2 / 20
    groups = {r.node: r.component for r in simhash.components(simhash.near_links(joined)).collect()}
    assert len({groups.get(r.node, r.node) for r in joined.select("node").distinct().collect()}) == 1
