"""What the training-data operators share: the cluster's shared folder, staged tables, tokenizer files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.session import new_folder, shared_dir, staged

__all__ = ["bytes_read", "documents", "free_names", "new_folder", "own_columns", "range_of", "shared_dir", "shuffle_partitions", "staged", "text_or_empty", "tokenizer_path"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, whatever its case, so that helper columns never meet input columns."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(f"{mark}{w}".lower() in taken for w in wanted):
        mark += "_"
    return [mark + w for w in wanted]


def own_columns(df: DataFrame, *results: str) -> list[str]:
    """The columns of ``df`` that are not named like a result, whatever their case."""
    taken = {r.lower() for r in results}
    return [c for c in df.columns if c.lower() not in taken]


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file of this name is."""
    return str(public_tokenizers.path(name))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_of(key: Column, cuts: list[int]) -> Column:
    """Number of cut points that are not above the key, by halving."""
    steps = 1 << max(0, len(cuts).bit_length() - 1)
    padded = F.lit(cuts + [(1 << 63) - 1] * (2 * steps - len(cuts)))
    halves = [steps >> i for i in range(steps.bit_length())]
    return F.aggregate(
        F.lit(halves).cast("array<int>"),
        F.lit(0),
        lambda at, step: F.when(F.element_at(padded, at + step) <= key, at + step).otherwise(at),
    )


def bytes_read(df: DataFrame) -> int:
    """What Spark expects a plan to read, from the sizes of its files; nothing is read for it. 0 where it doesn't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0
