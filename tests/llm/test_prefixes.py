"""The prefix trie against one that is built turn by turn."""

import hashlib
import re
import zlib

import pytest

from loomwork.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [totals[k] for k in children.get(node, [])]
        totals[node] = (sum(x[0] for x in below) or 1, sum(x[1] for x in below) + (len(members[node]) - 1) * words)
    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), parent, len(m), len(children.get(node, [])), *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in prefixes.prefix_trie(df).collect()), key=str)


def test_against_a_plain_trie(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert found(df) == plain([tuple(r) for r in df.collect()])


ODD = [
    (0, 0, "user", "a b"), (0, 1, "bot", "c"), (0, 2, None, None), (0, None, "user", "first of all"),
    (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 1, "bot", "c"), (2, 0, None, ""), (3, 5, "user", "a b"), (3, 7, "bot", "c"),
    (25, 1, "u", "no base here"), (25, 2, "u", "y z"), (26, 1, "u", "no base here"), (27, None, "u", None), (28, None, None, None),
    (-5, 1, "u", "negative"), (-5, 2, "u", "two words"), (-20, 1, "u", "negative"), (40, 1, "u", "short base"),
    *[(c, t, "u", f"turn {t}") for c in range(41, 60) for t in range(c % 5)], (None, 1, "u", "of none"), (None, None, None, None),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    assert found(df) == plain(ODD)
    extra = df.selectExpr("*", "'k' AS leg", "1 AS depth", "2 AS a", "'x' AS digest", "3 AS words", "4 AS row")
    assert found(extra) == plain(ODD)
    assert found(df.limit(0)) == []
    assert found(df.filter("conv_id is null")) == []


def test_a_conversation_without_turns_is_a_member_of_the_root(spark):
    rows = [(c, 0, "u", "t") for c in range(61, 80)]
    got = plain(rows)
    assert any(x[1] == 0 and x[3] > sum(y[3] for y in got if y[1] == 1) for x in got)
    assert found(spark.createDataFrame(rows, SCHEMA)) == got


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_a_hot_conversation_fills_several_ranges(spark, ranges):
    rows = [(20, t, "u", f"w {t % 3}") for t in range(700)] + [(c, t, "u", f"w {t % 3}") for c in (21, 22, 23, 24, 31) for t in range(60)]
    rows += [(c, 0, "u", "w 0") for c in range(100, 160)]
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_long_lists_of_ends(spark):
    rows = [(c, 0, "u", "same") for c in range(0, 5000, 3)] + [(c, 1, "u", "next") for c in range(0, 5000, 6)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
