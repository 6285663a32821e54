"""Catalog and serving operators: pages, first-per-key, histories, windows of messages, lifecycle scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STUCK_PENDING = "15 minutes"
STUCK_PROCESSING = "30 minutes"
MAX_RETRIES = 3
ALLOWED_FILTER_KEYS = frozenset(
    "source page author category tags language type format status priority".split()
)
RATE_LIMITS = {"chat": (10, "1 minute"), "retrieval": (100, "1 minute"), "upload": (20, "1 hour"), "auth": (5, "1 minute")}


def page(df: DataFrame, order: list, limit: int, offset: int, most: int = 100) -> tuple[DataFrame, bool]:
    """One page in a given order, and whether rows follow it. The limit is capped at ``most``."""
    limit = min(limit, most)
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows, bool(df.offset(offset + limit).limit(1).count())


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; one shuffle on the key, with a limit per partition before it."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def last_in_order(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def joined_in_order(rows: DataFrame, keys: list[str], order: Column, text: Column, sep: str) -> DataFrame:
    """Texts of each key in order, as one string; for groups of a bounded number of rows."""
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["t"]), sep).alias("joined"))


def message_line(role: Column, text: Column, chars: int = 1000) -> Column:
    """``User: ...`` or ``Assistant: ...``, long texts cut."""
    cut = F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)
    return F.concat(F.when(role == "user", "User: ").otherwise("Assistant: "), cut)


def may_start(status: Column) -> Column:
    return status == "pending"


def next_status(status: Column, outcome: Column) -> Column:
    """pending -> processing -> completed or failed; other moves leave the status as it is."""
    return (
        F.when((status == "pending") & (outcome == "start"), "processing")
        .when((status == "processing") & (outcome == "ok"), "completed")
        .when((status == "processing") & (outcome == "error"), "failed")
        .otherwise(status)
    )


def retry_scan(docs: DataFrame, now: Column) -> DataFrame:
    """Documents to queue again, with the reason and the new number of tries. One pass, no union."""
    pending = (F.col("status") == "pending") & (F.col("updated_at") < now - F.expr(f"INTERVAL {STUCK_PENDING}"))
    running = (F.col("status") == "processing") & (F.col("updated_at") < now - F.expr(f"INTERVAL {STUCK_PROCESSING}"))
    failed = (F.col("status") == "failed") & (F.coalesce("retry_count", F.lit(0)) < MAX_RETRIES)
    reason = F.when(pending, "stuck_pending").when(running, "stuck_processing").when(failed, "failed_retry")
    tries = F.coalesce("retry_count", F.lit(0)) + 1
    return docs.withColumn("reason", reason).filter(F.col("reason").isNotNull() & (tries <= MAX_RETRIES)).withColumn("tries", tries)


def check_filter(wanted: dict[str, str] | None) -> dict[str, str]:
    """A metadata filter that may go into a plan; ValueError says what is wrong with another one."""
    wanted = wanted or {}
    if len(wanted) > 10:
        raise ValueError(f"at most 10 filters, got {len(wanted)}")
    for key, value in wanted.items():
        if key not in ALLOWED_FILTER_KEYS:
            raise ValueError(f"no filter on {key!r}")
        if not isinstance(value, str) or len(value) > 256:
            raise ValueError(f"the value of {key!r} must be text of at most 256 characters")
    return wanted


def metadata_filter(df: DataFrame, column: str, wanted: dict[str, str] | None) -> DataFrame:
    """Rows whose JSON metadata has each wanted value, compared as text."""
    for key, value in check_filter(wanted).items():
        df = df.filter(F.get_json_object(column, f"$.{key}") == value)
    return df


def acceptable_metadata(column: Column) -> Column:
    """JSON object of at most 10000 characters and three levels; keys to 100, strings to 1000 characters."""
    depth = F.length(F.regexp_replace(column, r'"(?:[^"\\]|\\.)*"|[^{\[]', ""))
    long_key = column.rlike(r'"(?:[^"\\]|\\.){101,}"\s*:')
    long_text = column.rlike(r'"(?:[^"\\]|\\.){1001,}"')
    is_object = F.try_parse_json(column).isNotNull() & column.rlike(r"^\s*\{")
    return is_object & (F.length(column) <= 10_000) & (depth <= 3) & ~long_key & ~long_text


def confidence(scores: Column) -> Column:
    """Mean of an ordered array's first three scores, between 0 and 1, two places; 0 for none, 0.5 without scores."""
    top = F.filter(F.slice(scores, 1, 3), lambda s: s.isNotNull())
    mean = F.aggregate(top, F.lit(0.0), lambda a, s: a + s) / F.size(top)
    clamped = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)), 2)
    return F.when(F.size(scores) == 0, 0.0).when(F.size(top) == 0, 0.5).otherwise(clamped)


def is_grave(severity: Column) -> Column:
    """Whether a judgement's issue calls for a correction; counted with ``count_if``, so no list of issues is gathered."""
    return F.lower(severity).isin("high", "medium")


def judged_confidence(facts: Column, confidence: Column, failed: Column) -> Column:
    """A judgement's confidence: .5 where it failed, .7 where there are no facts (their number is given) to judge by."""
    return F.when(failed, F.lit(0.5)).when(facts <= 0, F.lit(0.7)).otherwise(confidence)


def renamed(collections: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(collections after, refused): names (user_id, id, name) taken where no other collection of the user has them.

    Of several that ask for one name the smallest id gets it.
    """
    first = Window.partitionBy("user_id", "name").orderBy("id")
    asked = wanted.withColumn("n", F.row_number().over(first))
    others = collections.select("user_id", F.col("id").alias("other"), "name")
    clash = asked.join(others, ["user_id", "name"], "left").groupBy("user_id", "id", "name", "n").agg(F.max(F.col("other") != F.col("id")).alias("taken"))
    free = (F.col("n") == 1) & ~F.coalesce("taken", F.lit(False))
    new = clash.filter(free).select("user_id", "id", F.col("name").alias("new_name"))
    after = collections.join(new, ["user_id", "id"], "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")
    return after, clash.filter(~free).select("user_id", "id", "name")


def charged(quotas: DataFrame, uses: DataFrame, now: Column) -> DataFrame:
    """Quotas (user_id, used, most, resets_at) after their uses (user_id, n): reset where the time is over, refused whole
    where a use goes beyond the limit; a limit of -1 never ends."""
    asked = uses.groupBy("user_id").agg(F.sum("n").alias("n"))
    over = F.col("resets_at") <= now
    base = F.when(over, 0).otherwise(F.col("used"))
    more = F.coalesce("n", F.lit(0))
    allowed = (F.col("most") < 0) | (base + more <= F.col("most"))
    done = quotas.join(asked, "user_id", "left")
    return done.select(
        "user_id", F.when(allowed, base + more).otherwise(base).alias("used"), "most",
        F.when(over, F.add_months(now, 1).cast("timestamp")).otherwise(F.col("resets_at")).alias("resets_at"), allowed.alias("allowed"),
    )
