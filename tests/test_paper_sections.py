"""Sections of papers, cut inside a text's row."""

from loomwork.operators import structure as S

PAPER = "preamble  \n1. Methods\n first \n\nsecond\nRESULTS\n2 Unknown\n  Conclusion \n"


def test_sections_with_places_and_no_shuffle(spark):
    docs = spark.createDataFrame([(1, PAPER), (2, "Abstract"), (3, "nothing"), (4, ""), (5, None)], "id int, text string")
    found = S.sections(docs, "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Window", "Join", "Exchange") if w in plan]
    rows = {(r.id, r.section): r for r in found.collect()}
    assert sorted(rows) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    shown = [(r.number, r.name, r.line_no, r.offset, r.next_offset, r.body) for _, r in sorted(rows.items())]
    places = [PAPER.index(x) for x in ("1. Methods", "RESULTS", "  Conclusion")]
    assert shown == [
        ("1.", "Methods", 1, places[0], places[1], "first\nsecond"), ("", "RESULTS", 5, places[1], places[2], "2 Unknown"), ("", "Conclusion", 7, places[2], None, ""), ("", "Abstract", 0, 0, None, ""),
    ]
