"""Tables from boxes: one shuffle for cells and texts, and the same results as a plain fold, whatever the batches are."""

import math
import random

from loomwork.operators import geometry as G

BOXES = "page int, id int, x0 double, y0 double, x1 double, y1 double, text string, layout string, colspan int, rowspan int"


def made(seed, pages, most):
    rng, rows = random.Random(seed), []
    for page in range(pages):
        for i in range(rng.randint(1, most)):
            x0, y0 = rng.choice([0.0, 10.0, 50.0, 50.0, 100.0]), rng.choice([0.0, 3.0, 9.0, 20.0, 24.0, 40.0, 61.5])
            text = rng.choice(["a", " b ", "", None, "Table 7: x", "cell"])
            rows.append((page, i, x0, y0, x0 + 40, y0 + rng.choice([8.0, 14.0, 20.0]), text, rng.choice(["", None, "Table Caption", "text"]), rng.choice([None, 1, 2]), rng.choice([None, 3])))
    return rows


def plain(boxes):
    """html and plain of one table's boxes."""
    kept = [b for b in boxes if not (b[6] or "").startswith("Table 7") and "caption" not in (b[7] or "").lower()]
    if not kept:
        return None
    limit, rows, first = min(b[5] - b[3] for b in kept) / 2, [], math.nan
    for b in sorted(kept, key=lambda b: (b[3], b[1])):
        if not b[3] - first < limit:
            rows, first = [*rows, []], b[3]
        rows[-1].append(b)
    read, rows, edge = [b for r in rows for b in sorted(r, key=lambda b: (b[2], b[3], b[1]))], [], math.nan
    for b in read:
        new = not b[3] < edge - G.ROW_SLACK
        rows, edge = ([*rows, []], b[5]) if new else (rows, (edge + b[5]) / 2)
        rows[-1].append(b)
    html, lines = "<table>\n", []
    for n, row in enumerate(rows):
        row = sorted(row, key=lambda b: b[2])
        spans = ["".join(f' {k}="{v}"' for k, v in (("colspan", b[8]), ("rowspan", b[9])) if v and v > 1) for b in row]
        texts, tag = [(b[6] or "").strip(" ") for b in row], "td" if n else "th"
        html += "  <tr>\n" + "".join(f"    <{tag}{s}>{t}</{tag}>\n" for s, t in zip(spans, texts, strict=True)) + "  </tr>\n"
        lines.append(" | ".join(texts))
    return html + "</table>", "\n".join(lines)


def test_tables_are_shuffled_once_and_equal_a_plain_fold(spark):
    rows = made(4, 60, 12) + [(60 + r[0], *r[1:]) for r in made(5, 1, 1)] + [(99, i, *r[2:]) for i, r in enumerate(made(6, 30, 30))]
    df = spark.createDataFrame(rows, BOXES)
    built = G.built_tables(df, "page", "id")
    moves = [w for w in built._jdf.queryExecution().executedPlan().toString().split() if w in ("Exchange", "Aggregate", "ObjectHashAggregate", "SortAggregate", "SortMergeJoin")]
    assert moves == ["Exchange"]
    by_page = {}
    for r in rows:
        by_page.setdefault(r[0], []).append(r)
    wanted = {k: v for k, v in ((page, plain(own)) for page, own in by_page.items()) if v}
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = built.collect()
            parts = G.table_texts(G.table_cells(df, "page", "id"), "page").collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(wanted) and {r.page: (r.html, r.plain) for r in got} == wanted
        assert sorted(map(tuple, parts)) == sorted(map(tuple, got))
    assert G.built_tables(df.limit(0), "page", "id").collect() == []
