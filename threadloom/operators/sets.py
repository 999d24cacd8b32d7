"""Unions, first and last rows per key, conflicts, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_first_wins(frames: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Rows of all frames in order; of rows with one key the first frame's first row. Rows without a key all stay."""
    key = F.coalesce(*[F.when(F.trim(F.col(k).cast("string")) != "", F.trim(F.col(k).cast("string"))) for k in keys])
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("_file", F.lit(i)) for i, f in enumerate(frames)]).withColumn("_key", key)
    # Rows without a key are set apart: they would all meet in one window.
    w = Window.partitionBy("_key").orderBy("_file", order)
    first = u.filter(F.col("_key").isNotNull()).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == 1)
    return first.select(frames[0].columns).unionByName(u.filter(F.col("_key").isNull()).select(frames[0].columns))


def keep_one(df: DataFrame, keys: list[str], order: list[F.Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one distinct trimmed label."""
    clean = F.lower(F.trim(label))
    return df.filter(F.col(label).isNotNull()).groupBy(key).agg(F.count_distinct(clean).alias("labels"), F.min(clean).alias("first_label"), F.max(clean).alias("last_label")).filter("labels > 1")


def counts(df: DataFrame, *fields: str) -> DataFrame:
    keys = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
