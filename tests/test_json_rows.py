"""JSON documents are opened and dealt inside their row: nothing is shuffled or written for it, and values are those Spark writes."""

import json

from loomwork.operators.json_split import json_nodes, split_json

TEXT = r'{"z": 1.50, "b": -0, "k\u001f\"": [1e5, "\u000bä \\u001f", {}, [ ]], "a": 1e25, "d": {"y": 0.1e1, "c": null}}'
VALUES = {
    '"z"': "1.5", '"b"': "0", r'"k\u001F\"""0"': "100000.0", r'"k\u001F\"""1"': r'"\u000B' + "ä" + r' \\u001f"', r'"k\u001F\"""2"': "{}", r'"k\u001F\"""3"': "{}",
    '"a"': "1.0E25", '"d""y"': "1.0", '"d""c"': "null",
}


def test_documents_stay_in_their_row(spark):
    docs = spark.range(40).selectExpr("id", """'{"a": [1, {"b": "x"}], "c": 2}' AS text""")
    for found in (split_json(docs, "id", "text", 20, 8), json_nodes(docs, "id", "text")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not [w for w in ("Exchange", "Join", "Aggregate", "parquet") if w in plan]
        assert found.select("id").distinct().count() == 40


def test_values_are_written_by_spark_in_the_order_of_keys(spark):
    docs = spark.createDataFrame([(1, TEXT)], "id int, text string")
    leaves = json_nodes(docs, "id", "text").filter("is_leaf").orderBy("place").collect()
    assert [("".join(r.path), r.value) for r in leaves] == list(VALUES.items())
    chunk = split_json(docs, "id", "text").first()
    assert list(json.loads(chunk.content)) == ["z", "b", 'k\x1f"', "a", "d"] and '"y": 1.0' in chunk.content
