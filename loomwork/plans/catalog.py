"""Registered catalog, history and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.operators import relational as R
from loomwork.session import table


def counts_per_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers' nations as collections, with their customers; nations without one count 0."""
    nations, customers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    counts = customers.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    joined = nations.join(counts, nations.n_nationkey == counts.c_nationkey, "left")
    return joined.select("n_name", F.coalesce("n", F.lit(0)).alias("documents"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", "source", "n_chars")
    rows, more = R.page(docs, ["doc_id"], limit=500, offset=20)
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.lit(more))


def status_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    rows, _ = R.page(orders, [F.desc("o_orderdate"), "o_orderkey"], limit=25, offset=0)
    return rows.select("o_orderkey", "o_orderstatus")


def uploads_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.filter(F.octet_length("text") <= 8000).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with message counts, latest turn first, sessions without answers last."""
    turns = table(spark, sf_dir, "conversations")
    per = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last_answer"),
        F.min_by(F.substring("text", 1, 100), "turn").alias("title"),
    )
    order = Window.orderBy(F.desc_nulls_last("last_answer"), "conv_id")
    return per.orderBy(F.desc_nulls_last("last_answer"), "conv_id").limit(20).withColumn("place", F.row_number().over(order))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = R.last_in_order(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 4)
    line = R.message_line(F.col("role"), F.col("text"))
    return R.joined_in_order(last, ["conv_id"], F.col("turn"), line, "\n\n").withColumnRenamed("joined", "context")


def reformulation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = R.last_in_order(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 3)
    line = F.concat("role", F.lit(": "), F.substring("text", 1, 100))
    return R.joined_in_order(last, ["conv_id"], F.col("turn"), line, "\n").withColumnRenamed("joined", "context")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept document of each content, with the number of rejected copies. The hash is grouped, texts never meet."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), (F.count(F.lit(1)) - 1).alias("rejected"))


STATUS = "element_at(array('pending','processing','completed','failed'), cast(event_id % 4 + 1 as int))"
STATUS_SQL = "['pending','processing','completed','failed'][event_id % 4 + 1]"


def _lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.expr(STATUS).alias("status"), F.col("ts").cast("timestamp").alias("updated_at"), (F.col("event_id") % 5).cast("int").alias("retry_count")
    )


def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _lifecycle(spark, sf_dir)
    latest = docs.agg(F.max("updated_at").alias("now"))
    found = R.retry_scan(docs.crossJoin(F.broadcast(latest)), F.col("now"))
    return found.select("event_id", "reason", "tries")


def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.expr("element_at(array('start','ok','error'), cast(event_id % 3 + 1 as int))")
    docs = _lifecycle(spark, sf_dir).withColumn("outcome", outcome)
    after = R.next_status(F.col("status"), F.col("outcome"))
    return docs.groupBy("status", "outcome", after.alias("after"), R.may_start(F.col("status")).alias("may_start")).agg(F.count(F.lit(1)).alias("n"))


def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls per user and minute, and whether the limit of their kind is passed."""
    events = table(spark, sf_dir, "events")
    per = events.groupBy("user_id", "event_type", F.date_trunc("hour", "ts").cast("timestamp").alias("at")).agg(F.count(F.lit(1)).alias("calls"))
    over = F.col("calls") > F.when(F.col("event_type") == "click", 1).otherwise(2)
    return per.groupBy("event_type").agg(F.count(F.lit(1)).alias("windows"), F.count_if(over).alias("limited"), F.max("calls").alias("most"))


def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("used"))
    percent = F.round(F.col("used") * 100.0 / 25, 2)
    return used.select("user_id", "used", (25 - F.col("used")).alias("available"), percent.alias("percent"), (percent >= 80).alias("warning"))


def hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of a cache that remembers a user's page: a call is a hit if the user has called before."""
    events = table(spark, sf_dir, "events")
    seen = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) > 1
    per = events.withColumn("hit", seen).groupBy("event_type").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return per.withColumn("hit_rate", F.round(F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1)), 6))


def cache_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a keyed table with a day's lifetime: the latest of each key that hasn't run out."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    latest = events.agg((F.max("ts") - F.expr("INTERVAL 24 HOURS")).alias("oldest"))
    kept = R.first_per_key(events, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return kept.crossJoin(F.broadcast(latest)).filter("ts > oldest").select("user_id", "event_id")


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the hash of the key they present; expired keys and inactive users don't pass."""
    users = table(spark, sf_dir, "customer")
    keys = users.select("c_custkey", F.sha2(F.concat(F.lit("key_"), F.col("c_custkey").cast("string")), 256).alias("key_hash"), "c_acctbal", "c_mktsegment")
    shown = table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat(F.lit("key_"), F.col("o_custkey").cast("string")), 256).alias("key_hash"))
    passed = shown.join(keys, "key_hash").filter("c_acctbal > 0 and c_mktsegment <> 'MACHINERY'")
    return passed.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("calls"))


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New addresses only (anti join on the address in use), with the shown part of their key."""
    users = table(spark, sf_dir, "customer").select(F.lower(F.concat("c_name", F.lit("@example.com"))).alias("email"))
    asking = table(spark, sf_dir, "supplier").select(F.lower(F.concat("s_name", F.lit("@example.com"))).alias("email"))
    both = asking.unionByName(users)
    fresh = both.join(users, "email", "left_anti")
    return fresh.select("email", F.substring(F.concat(F.lit("key_"), F.sha2("email", 256)), 1, 15).alias("prefix"))


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a user may still give a collection: no row of the user has them."""
    have = table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("user_id"), F.col("source").alias("name")).distinct()
    want = table(spark, sf_dir, "documents").select(F.lit(3).cast("long").alias("user_id"), F.concat("source", F.when(F.col("doc_id") % 2 == 0, "-b").otherwise("")).alias("name")).distinct()
    return want.join(have, ["user_id", "name"], "left_anti")


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit value, else the preset's, else the global one."""
    presets = spark.createDataFrame([("concise", 0.3, 500), ("detailed", 0.5, 2000), ("research", 0.2, 4000)], "preset string, t double, m int")
    asked = table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.expr("element_at(array('concise','detailed','research','none'), cast(item_id % 4 + 1 as int))").alias("preset"),
        F.when(F.col("item_id") % 5 == 0, F.lit(0.9)).alias("own_t"),
    )
    joined = asked.join(F.broadcast(presets), "preset", "left")
    return joined.select("item_id", F.coalesce("own_t", "t", F.lit(0.7)).alias("temperature"), F.coalesce("m", F.lit(1000)).alias("max_tokens"))


def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of each user's events, values as scores, best first."""
    score = F.when(F.col("event_id") % 11 != 0, F.col("value") / 100)
    events = table(spark, sf_dir, "events").select("user_id", "event_id", score.alias("score"))
    top = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("score"), "event_id")
    first = events.withColumn("n", F.row_number().over(top)).filter("n <= 3")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "score"))), lambda x: x["score"])
    return first.groupBy("user_id").agg(R.confidence(listed).alias("confidence"))


def metadata_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("meta", F.expr("to_json(named_struct('page', cast(user_id % 3 as string), 'status', event_type, 'n', event_id))"))
    found = R.metadata_filter(events, "meta", {"page": "1", "status": "click"})
    return found.select("event_id")


def metadata_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.expr(
        "element_at(array('{\"a\":1}','{\"a\":{\"b\":{\"c\":1}}}','{\"a\":{\"b\":{\"c\":{\"d\":1}}}}','[1]','{bad', concat('{\"a\":\"', repeat('x', 1001), '\"}'), "
        "concat('{\"', repeat('k', 101), '\":1}'), '{\"a\":\"{{{{{{\"}'), cast(event_id % 8 + 1 as int))"
    )
    events = table(spark, sf_dir, "events").select((F.col("event_id") % 8).alias("kind"), meta.alias("m"))
    return events.groupBy("kind", R.acceptable_metadata(F.col("m")).alias("accepted")).agg(F.count(F.lit(1)).alias("n"))


def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five documents of each source by size, with a snippet."""
    docs = table(spark, sf_dir, "documents")
    best = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    snippet = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    top = docs.withColumn("place", F.row_number().over(best)).filter("place <= 5")
    return top.select("source", "place", "doc_id", F.round(F.col("n_chars") / 7000, 3).alias("relevance"), snippet.alias("snippet"))


def annotation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks (turns) with the first annotation of their index."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    notes = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("conv_id"), (F.col("event_id") % 6).alias("turn"), "event_id", "event_type")
    first = notes.groupBy("conv_id", "turn").agg(F.min_by("event_type", "event_id").alias("note"))
    return turns.join(first, ["conv_id", "turn"], "left")


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped inside [start, end) of each order's ten days: lines are counted per day first, so each order meets ten
    rows by an equi-join however many lines a day has."""
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    start = F.col("o_orderdate").cast("date")
    spans = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(start, F.date_add(start, 9))).alias("day"))
    return spans.join(days, "day").groupBy("o_orderkey").agg(F.sum("n").alias("points"))


def media_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tables = docs.filter("text like '%|%'").select(F.lit("table").alias("kind"), "source", F.lit("Data table from document").alias("description"))
    lists = docs.filter("text like '%!!%'").select(F.lit("shout").alias("kind"), "source", F.lit(None).cast("string").alias("description"))
    return tables.unionByName(lists).dropDuplicates(["kind", "source", "description"])


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that call for a correction, and the confidence of each user's judgement."""
    severity = F.expr("element_at(array('high', 'Medium', 'low', 'none'), cast(event_id % 4 + 1 as int))")
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(R.is_grave(severity)).cast("int").alias("grave"), F.count_if(F.col("event_type") == "purchase").alias("facts")
    )
    confidence = R.judged_confidence(F.col("facts"), F.lit(0.9), F.col("user_id") % 7 == 0)
    return per.select("user_id", "grave", confidence.alias("confidence"))


def renamed_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as collections of their brand's owner; every third asks for the name of the part after the next, or a new one."""
    have = table(spark, sf_dir, "part").select(F.col("p_brand").alias("user_id"), F.col("p_partkey").alias("id"), F.concat(F.lit("c"), (F.col("p_partkey") % 40).cast("string"), F.lit("-"), "p_partkey").alias("name"))
    new = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("new"), (F.col("p_size") % 5).cast("string"))).otherwise(F.concat(F.lit("c"), (F.col("p_partkey") % 40).cast("string"), F.lit("-"), "p_partkey"))
    asked = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.col("p_brand").alias("user_id"), F.col("p_partkey").alias("id"), new.alias("name"))
    after, _ = R.renamed(have, asked)
    return after.select("user_id", "id", "name")


def quota_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    quotas = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 50).alias("used"), F.when(F.col("c_custkey") % 10 == 0, -1).otherwise(60).alias("most"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit("2024-05-01 00:00:00")).otherwise(F.lit("2024-07-01 00:00:00")).cast("timestamp").alias("resets_at"),
    )
    uses = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.lit(3).alias("n"))
    done = R.charged(quotas, uses, now)
    return done.select("user_id", "used", "most", F.date_format("resets_at", "yyyy-MM-dd").alias("resets"), "allowed")


QUERIES = {
    "g12_judgements": judgements,
    "g1_renames": renamed_collections,
    "g6_charges": quota_charges,
    "a1_counts_per_collection": counts_per_collection,
    "a2_k5_listing": listing,
    "f9_status_listing": status_listing,
    "f10_upload_cap": uploads_allowed,
    "a10_k6_g5_sessions": sessions,
    "w5_w6_history": history,
    "t12_reformulation_context": reformulation_context,
    "c7_exact_duplicates": exact_duplicates,
    "g4_u1_retry_scan": retries,
    "g3_state_machine": state_machine,
    "g8_rate_limits": rate_limits,
    "a13_g6_quotas": quotas,
    "a14_hit_rates": hit_rates,
    "g7_cache_expiry": cache_expiry,
    "j9_api_keys": api_keys,
    "g9_registrations": registrations,
    "g1_unique_names": unique_names,
    "g15_settings": settings,
    "a11_confidence": confidences,
    "f2_metadata_filter": metadata_filters,
    "f5_metadata_checks": metadata_checks,
    "t23_source_list": source_list,
    "j8_annotation_join": annotation_join,
    "j10_interval_join": interval_join,
    "u5_media_union": media_union,
}
ORACLES = {
    "g12_judgements": """
        SELECT user_id, (count(*) FILTER (event_id % 4 < 2))::INT AS grave, CASE WHEN user_id % 7 = 0 THEN 0.5 WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence
        FROM events GROUP BY user_id""",
    "g1_renames": """
        WITH a AS (SELECT p_brand, p_partkey, 'new' || (p_size % 5) AS name, row_number() OVER (PARTITION BY p_brand, p_size % 5 ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 6 = 0)
        SELECT p_brand AS user_id, p_partkey AS id, coalesce(a.name, 'c' || (p_partkey % 40) || '-' || p_partkey) AS name FROM part LEFT JOIN a USING (p_brand, p_partkey)
        WHERE a.n IS NULL OR a.n = 1
        UNION ALL SELECT p_brand, p_partkey, 'c' || (p_partkey % 40) || '-' || p_partkey FROM a WHERE n > 1""",
    "g6_charges": """
        WITH u AS (SELECT o_custkey, 3 * count(*) AS n FROM orders GROUP BY 1),
        q AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 50 END AS base, coalesce(n, 0) AS n, CASE WHEN c_custkey % 10 = 0 THEN -1 ELSE 60 END AS most
              FROM customer LEFT JOIN u ON o_custkey = c_custkey)
        SELECT user_id, CASE WHEN most < 0 OR base + n <= most THEN base + n ELSE base END::BIGINT AS used, most, '2024-07-01' AS resets, most < 0 OR base + n <= most AS allowed FROM q""",
    "a1_counts_per_collection": """SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS documents FROM nation""",
    "a2_k5_listing": """
        WITH d AS (SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en')
        SELECT *, (SELECT count(*) FROM d) AS total, (SELECT count(*) FROM d) > 120 AS has_more FROM (SELECT * FROM d ORDER BY doc_id LIMIT 100 OFFSET 20)""",
    "f9_status_listing": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25",
    "f10_upload_cap": "SELECT source, count(*) AS n FROM documents WHERE strlen(text) <= 8000 GROUP BY source",
    "a10_k6_g5_sessions": """
        WITH s AS (SELECT conv_id, count(*) AS messages, max(turn) FILTER (role = 'assistant') AS last_answer, arg_min(text[1:100], turn) AS title
                   FROM conversations GROUP BY conv_id)
        SELECT *, row_number() OVER (ORDER BY last_answer DESC NULLS LAST, conv_id)::INT AS place FROM s ORDER BY last_answer DESC NULLS LAST, conv_id LIMIT 20""",
    "w5_w6_history": """
        SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || CASE WHEN length(text) > 1000 THEN text[1:1000] || '...' ELSE text END,
                                   chr(10) || chr(10) ORDER BY turn) AS context
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4 GROUP BY conv_id""",
    "t12_reformulation_context": """
        SELECT conv_id, string_agg(role || ': ' || text[1:100], chr(10) ORDER BY turn) AS context
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3 GROUP BY conv_id""",
    "c7_exact_duplicates": "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) - 1 AS rejected FROM documents GROUP BY 1",
    "g4_u1_retry_scan": f"""
        WITH e AS (SELECT event_id, {STATUS_SQL} AS status, ts, event_id % 5 AS c, max(ts) OVER () AS now FROM events)
        SELECT event_id, 'stuck_pending' AS reason, (c + 1)::INT AS tries FROM e WHERE status = 'pending' AND ts < now - INTERVAL 15 MINUTE AND c < 3
        UNION ALL SELECT event_id, 'stuck_processing', (c + 1)::INT FROM e WHERE status = 'processing' AND ts < now - INTERVAL 30 MINUTE AND c < 3
        UNION ALL SELECT event_id, 'failed_retry', (c + 1)::INT FROM e WHERE status = 'failed' AND c < 3""",
    "g3_state_machine": f"""
        WITH e AS (SELECT {STATUS_SQL} AS status, ['start','ok','error'][event_id % 3 + 1] AS outcome FROM events)
        SELECT status, outcome, CASE status || '>' || outcome WHEN 'pending>start' THEN 'processing' WHEN 'processing>ok' THEN 'completed'
               WHEN 'processing>error' THEN 'failed' ELSE status END AS after, status = 'pending' AS may_start, count(*) AS n FROM e GROUP BY ALL""",
    "g8_rate_limits": """
        WITH p AS (SELECT user_id, event_type, date_trunc('hour', ts) AS at, count(*) AS calls FROM events GROUP BY ALL)
        SELECT event_type, count(*) AS windows, count(*) FILTER (calls > CASE event_type WHEN 'click' THEN 1 ELSE 2 END) AS limited, max(calls) AS most FROM p GROUP BY 1""",
    "a13_g6_quotas": """
        SELECT user_id, count(*) AS used, 25 - count(*) AS available, round(count(*) * 100.0::DOUBLE / 25, 2) AS percent, round(count(*) * 100.0::DOUBLE / 25, 2) >= 80 AS warning
        FROM events GROUP BY user_id""",
    "a14_hit_rates": """
        WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)
        SELECT event_type, sum(n - 1)::BIGINT AS hits, count(*) AS misses, round(sum(n - 1)::DOUBLE / sum(n)::DOUBLE, 6) AS hit_rate FROM c GROUP BY event_type""",
    "g7_cache_expiry": """
        SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
        WHERE n = 1 AND ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""",
    "j9_api_keys": """
        SELECT c_custkey, count(*) AS calls FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND c_mktsegment <> 'MACHINERY' GROUP BY 1""",
    "g9_registrations": """
        SELECT lower(s_name || '@example.com') AS email, ('key_' || sha256(lower(s_name || '@example.com')))[1:15] AS prefix FROM supplier
        WHERE lower(s_name) NOT IN (SELECT lower(c_name) FROM customer)""",
    "g1_unique_names": """
        WITH w AS (SELECT DISTINCT source || CASE WHEN doc_id % 2 = 0 THEN '-b' ELSE '' END AS name FROM documents)
        SELECT 3::BIGINT AS user_id, name FROM w WHERE name NOT IN (SELECT source FROM documents WHERE doc_id % 7 = 3)""",
    "g15_settings": """
        SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 0.9 ELSE [0.3, 0.5, 0.2, 0.7][item_id % 4 + 1] END::DOUBLE AS temperature,
               [500, 2000, 4000, 1000][item_id % 4 + 1]::INT AS max_tokens FROM benchmark""",
    "a11_confidence": """
        WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 11 <> 0 THEN value / 100 END AS score FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, event_id) AS n FROM e),
        l AS (SELECT user_id, list(score ORDER BY n) FILTER (score IS NOT NULL) AS s FROM r WHERE n <= 3 GROUP BY user_id)
        SELECT user_id, CASE WHEN s IS NULL THEN 0.5::DOUBLE ELSE round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, list_reduce(s, lambda a, x: a + x, 0.0::DOUBLE) / len(s))), 2) END AS confidence FROM l""",
    "f2_metadata_filter": "SELECT event_id FROM events WHERE user_id % 3 = 1 AND event_type = 'click'",
    "f5_metadata_checks": "SELECT event_id % 8 AS kind, event_id % 8 IN (0, 1, 7) AS accepted, count(*) AS n FROM events GROUP BY ALL",
    "t23_source_list": """
        SELECT source, n::INT AS place, doc_id, round(n_chars::DOUBLE / 7000, 3) AS relevance, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS snippet
        FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 5""",
    "j8_annotation_join": """
        WITH a AS (SELECT user_id % 50 AS c, event_id % 6 AS t, arg_min(event_type, event_id) AS note FROM events GROUP BY ALL)
        SELECT conv_id, turn, note FROM conversations LEFT JOIN a ON conv_id = c AND turn = t""",
    "j10_interval_join": """
        WITH d AS (SELECT l_shipdate::DATE AS day, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT o_orderkey, sum(n)::BIGINT AS points FROM orders JOIN d ON day >= o_orderdate::DATE AND day < o_orderdate::DATE + 10 GROUP BY 1""",
    "u5_media_union": """
        SELECT DISTINCT 'table' AS kind, source, 'Data table from document' AS description FROM documents WHERE text LIKE '%|%'
        UNION ALL SELECT DISTINCT 'shout', source, NULL FROM documents WHERE text LIKE '%!!%'""",
}
