"""Chunks of JSON documents against a plain recursive splitter."""

import json
import random

from loomwork.operators.json_split import json_nodes, split_json


def keyed(x):
    if isinstance(x, list):
        return {str(i): keyed(y) for i, y in enumerate(x)}
    return {k: keyed(v) for k, v in x.items()} if isinstance(x, dict) else x


def size(x):
    return len(json.dumps(x, ensure_ascii=False))


def plain(data, most, least):
    chunks = [{}]

    def put(path, value):
        d = chunks[-1]
        for k in path[:-1]:
            d = d.setdefault(k, {})
        d[path[-1]] = value

    def split(d, path):
        for k, v in d.items():
            fits = size({k: v}) < most - size(chunks[-1])
            if not fits and size(chunks[-1]) >= least:
                chunks.append({})
            if fits or not isinstance(v, dict) or not v:
                put([*path, k], v)
            else:
                split(v, [*path, k])

    if isinstance(data, (dict, list)):
        split(keyed(data), [])
    return [json.dumps(c, ensure_ascii=False, indent=2) for c in chunks if c]


def made(rng, depth):
    kind = rng.random()
    if depth and kind < 0.5:
        return {rng.choice(["a", "key", "ä\"b", "long name", "z", "日本"]) + str(i): made(rng, depth - 1) for i in range(rng.randint(0, 6))}
    if depth and kind < 0.75:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 12))]
    return rng.choice([None, True, False, 7, -12345, 2.5, "", "text", "quoted \"x\" \\ \n tab\t", "ümlaut 日本", "w" * rng.randint(1, 90), "{not}", "[no]", "12"])


def test_against_a_plain_splitter(spark):
    rng = random.Random(11)
    docs = [(i, json.dumps(made(rng, 4), ensure_ascii=False)) for i in range(80)]
    df = spark.createDataFrame(docs, "id int, text string")
    for most, least in ((60, 30), (300, 120), (4000, 1800)):
        got = {}
        for r in split_json(df, "id", "text", most, least).collect():
            got.setdefault(r.id, []).append((r.chunk, r.content))
            assert r.n_chars == size(json.loads(r.content))
        for i, text in docs:
            assert [c for _, c in sorted(got.get(i, []))] == plain(json.loads(text), most, least)


def test_lists_are_in_order_of_numbers_and_nothing_is_lost(spark):
    doc = {"list": [{"n": i, "text": "x" * 20} for i in range(25)], "last": [], "none": {}}
    rows = split_json(spark.createDataFrame([(1, json.dumps(doc))], "id int, text string"), "id", "text", 200, 90).collect()
    whole, seen = {}, []
    for r in sorted(rows, key=lambda r: r.chunk):
        part = json.loads(r.content)
        assert size(part) <= 200
        seen += [int(k) for k in part.get("list", {})]
        for k, v in part.items():
            whole.setdefault(k, {}).update(v)
    assert sorted(set(seen)) == list(range(25)) and seen == sorted(seen)
    assert whole["last"] == {} and whole["none"] == {}
    assert sorted(whole["list"]) == sorted(str(i) for i in range(25))


def test_odd_documents(spark):
    texts = [None, "", "{bad", "5", '"text"', "{}", "[]", '{"a":1,"a":2}', ' {"a": [1, 2.50, "2"]} ', "null", "[[[1]]]"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: json.loads(r.content) for r in split_json(df, "id", "text").collect()}
    assert got == {8: {"a": {"0": 1, "1": 2.5, "2": "2"}}, 10: {"0": {"0": {"0": 1}}}}
    assert split_json(df.limit(0), "id", "text").collect() == []
    assert json_nodes(df.limit(0), "id", "text").collect() == []
