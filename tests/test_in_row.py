"""Operators that work inside a document's row: same results as over lines, and no window, sort or join of lines in their plans."""

import random

from pyspark.sql import functions as F

from loomwork.operators import structure as S
from loomwork.operators.merging import hierarchical_merge, merge_levels, text_levels, tree_merge

LINES = ["PART ONE", "Chapter 2", "Section 3. Scope", "Article 4", "1. One", "1.2. Two", "1.2.3 three", "# A", "## B", "(a) x", "text", "more, text", "7", "", "x", "0 none", "1 2 no", "SECTION", "a@b"]
TITLE = lambda line: F.when(line.rlike("^SECTION"), "title").otherwise("")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moves(df):
    return [w for w in ("Window", "SortMergeJoin", "HashJoin", "Exchange") if w in plan(df)]


def texts(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(LINES) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    return spark.createDataFrame([*rows, (-1, ""), (-2, "no heading\nat all"), (-3, None)], "id int, text string")


def test_merges_of_texts_are_those_of_lines_without_a_shuffle(spark):
    docs = texts(spark)
    own = text_levels(docs, "id", layout=TITLE)
    lines = merge_levels(S.explode_lines(docs, "id"), "id", TITLE(F.col("line")))
    for merge in (tree_merge, hierarchical_merge):
        for depth, most in ((1, None), (2, 3), (3, 100)):
            found = merge(own, "id", depth, most)
            assert not moves(found)
            rows = sorted(found.collect(), key=str)
            assert rows and rows == sorted(merge(lines, "id", depth, most).collect(), key=str)


def plain_tree(lines, levels, size, depth, most):
    seen = sorted(set(levels))
    target = seen[min(depth, len(seen)) - 1]
    target = seen[-2] if target == size + 1 and len(seen) > 1 else target
    heads = [i for i, x in enumerate(levels) if x <= target]
    out = [lines[: heads[0]]] if heads[0] else []
    for a, b in zip(heads, [*heads[1:], len(lines)], strict=True):
        if b < len(lines) and levels[b] > levels[a]:
            continue
        above = [h for h in heads if h < a and levels[h] < levels[a] and not any(h < g < a and levels[g] <= levels[h] for g in heads)]
        out.append([x for h in [*above, a] for x in lines[h : next((g for g in heads if g > h), len(lines))]])
    return out[:most]


def test_trees_against_brute_force(spark):
    rows = text_levels(texts(spark), "id", layout=TITLE)
    kept = {r.id: r for r in rows.filter("levels is not null").collect()}
    for depth, most in ((1, None), (2, 4), (3, None)):
        got = {}
        for r in tree_merge(rows, "id", depth, most).orderBy("id", "at").collect():
            got.setdefault(r.id, []).append(r.lines)
        assert got == {i: plain_tree(r.lines, r.levels, r.size, depth, most) for i, r in kept.items() if r.lines}
