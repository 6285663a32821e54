"""Mixing sources to target weights: capped water-filling over sources, then seeded whole and fractional repetitions.

Everything is DataFrame code. Sources are ranked by name (code points, null last) and take the weights in a repeating
pattern. The words to hand out are a share of all words; a source stops at ``max_epochs`` times its own words, and what
it can't use is dealt again over the others by weight. That fixed point has a closed form: with sources ordered by
cap / weight, the first k are at their cap and the rest get ``level * weight``.

Within a source every document is taken ``floor(target / size)`` times, and once more if it lies in the first part of a
seeded random order whose words make up the fraction that is left. The order has two levels: about sqrt(rows) hash
buckets per source, and a hash inside the bucket, so a running sum never needs more than about sqrt(rows) rows of one
source in a task, however hot the source is.

Defined results: null or empty text has size 0; a null source is a source of its own, ranked last; a source without
words gets target 0 and nothing is taken; repeated rows count as rows of their own; an empty table gives an empty one;
columns named like the results are replaced, other columns pass through, whatever they are called (a row travels as one
struct beside the helper columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm._common import documents, free_names, own_columns, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """One row per source: source, _key, rows, source_size, target. ``sizes`` has source, _key and size."""
    per_source = sizes.groupBy("_key", "source").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").cast("long").alias("source_size")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        per_source.withColumn("_rank", F.row_number().over(by_name) - 1)
        .withColumn("_weight", F.element_at(pattern, (F.col("_rank") % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_budget", F.lit(float(share)) * F.sum("source_size").over(whole))
        .withColumn("_weights", F.sum("_weight").over(whole))
    )
    # The level if exactly the sources before this one were at their cap; it holds for the first one it does not exceed.
    levelled = ranked.withColumn(
        "_level",
        (F.col("_budget") - F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0.0)))
        / (F.col("_weights") - F.coalesce(F.sum("_weight").over(by_ratio), F.lit(0.0))),
    ).withColumn(
        "_first",
        F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(whole),
    )
    target = F.when(
        F.col("_first").isNull() | (F.struct("_ratio", "_rank") < F.struct("_first._ratio", "_first._rank")),
        F.col("_cap"),
    ).otherwise(F.least(F.col("_cap"), F.col("_first._level") * F.col("_weight")))
    return levelled.select("_key", "source", "rows", "source_size", target.alias("target"))


def _hash(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _hex(start: int, length: int) -> Column:
    return F.conv(F.substring("_hash", start, length), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    size: Column | None = None,
) -> DataFrame:
    """``docs`` with size, source_size, target (its source's), repeats (0 to max_epochs) and taken (repeats * size)."""
    results = ["size", "source_size", "target", "repeats", "taken"]
    kept = own_columns(docs, *results)
    measured = word_count(F.col("text")) if size is None else size
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    sized = docs.select(
        F.struct(*kept).alias("row"), "doc_id", "source", measured.alias("size"), key.alias("_key"), _hash(seed).alias("_hash")
    )
    narrow = staged(sized.drop("row"), "mix-sizes")
    targets = staged(source_targets(narrow, weights, share, max_epochs), "mix-targets").withColumn(
        "_buckets", F.ceil(F.sqrt(F.col("rows"))).cast("long")
    )
    plan = targets.select("_key", "source_size", "target", "_buckets")
    bucket = F.pmod(_hex(1, 8), F.col("_buckets")).alias("_bucket")
    totals = (
        narrow.join(plan, "_key")
        .select("_key", "size", bucket)
        .groupBy("_key", "_bucket")
        .agg(F.sum("size").alias("_bucket_size"))
    )
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(
        totals.select(
            "_key", "_bucket", F.coalesce(F.sum("_bucket_size").over(earlier), F.lit(0)).alias("_bucket_start")
        ),
        "mix-buckets",
    )
    within = (
        Window.partitionBy("_key", "_bucket")
        .orderBy(_hex(9, 15), "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = (
        sized.join(plan, "_key")
        .withColumn("_bucket", F.pmod(_hex(1, 8), F.col("_buckets")))
        .withColumn("_upto", F.sum("size").over(within))
        .join(starts, ["_key", "_bucket"])
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    middle = F.col("_bucket_start") + F.col("_upto") - F.col("size") / F.lit(2.0)
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    more = (F.col("_whole") < max_epochs) & (rest > 0) & (middle <= rest)
    return (
        placed.withColumn("_whole", whole)
        .withColumn("repeats", F.col("_whole") + F.when(more, 1).otherwise(0))
        .withColumn("taken", F.col("repeats") * F.col("size"))
        .select(*[F.col("row").getField(c).alias(c) for c in kept], *results)
    )


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as many times as it is taken."""
    (copy,) = free_names(mixed, "copy")
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col("repeats").cast("int")))).select(*columns)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix of ``docs`` with their columns as they are, also those named like results."""
    held = docs.select(F.struct(*docs.columns).alias("document"), "doc_id", "source", word_count(F.col("text")).alias("words"))
    return repeated(mix_sources(held, size=F.col("words")), ["document"]).select("document.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = staged(
        documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("words")), "mix-words"
    )
    return mix_sources(sizes, size=F.col("words")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "repeats"
    )


OP1_SQL = """
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
           md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS h
    FROM documents),
src AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
    SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM src),
capped AS (
    SELECT *, ([3.0, 1.0, 2.0])[(rk % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM ranked),
ratio AS (SELECT *, cap / w AS r, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget, sum(w) OVER () AS ws FROM capped),
level AS (
    SELECT *, (budget - coalesce(sum(cap) OVER before, 0.0)) / (ws - coalesce(sum(w) OVER before, 0.0)) AS lv
    FROM ratio WINDOW before AS (ORDER BY r, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
hit AS (SELECT r AS r0, rk AS rk0, lv AS lv0 FROM level WHERE lv <= r ORDER BY r, rk LIMIT 1),
targets AS (
    SELECT source, n, source_size,
           CASE WHEN lv0 IS NULL OR r < r0 OR (r = r0 AND rk < rk0) THEN cap ELSE least(cap, lv0 * w) END AS target
    FROM level LEFT JOIN hit ON true),
dealt AS (
    SELECT s.*, t.source_size, t.target,
           ('0x' || substr(h, 1, 8))::BIGINT % ceil(sqrt(t.n))::BIGINT AS bucket, ('0x' || substr(h, 9, 15))::BIGINT AS h2
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
summed AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY bucket, h2, doc_id, size
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
           CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
    FROM dealt),
final AS (
    SELECT *, whole + CASE WHEN whole < 2 AND target - whole * source_size > 0
                            AND upto - size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END AS repeats
    FROM summed)
SELECT doc_id, size, source_size, target, (repeats * size)::BIGINT AS taken, source, repeats::BIGINT AS repeats FROM final
"""
