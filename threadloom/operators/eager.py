"""Per-key results over inputs in which a few keys hold most rows.

Grouping or joining raw rows by such a key puts most of them into one task.
Here both inputs are reduced to one small state per key before anything is
joined: Spark combines rows into states within each map task, so a key sends at
most one state per map task through the shuffle, however many rows it has. The
states of the two sides are joined, and what the join of the raw rows would have
given follows by algebra: the pairs of a key are the product of its counts, a
sum over pairs is the one side's sum times the other side's count. The group of
a hot key is never in one place, and no salt is needed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.keys import plain_key


def unpivot_keys(df: DataFrame, keys: Mapping[str, Column], keep: Mapping[str, Column]) -> DataFrame:
    """One row per record and key field with a value: key_field, key_value and ``keep``."""
    pairs = F.array(*[F.struct(F.lit(name).alias("key_field"), value.cast("string").alias("key_value")) for name, value in keys.items()])
    named = df.select(F.explode(pairs).alias("_k"), *[c.alias(n) for n, c in keep.items()])
    return named.select("_k.key_field", "_k.key_value", *keep).filter(F.col("key_value").isNotNull())


def states(df: DataFrame, measures: Mapping[str, Column], prefix: str) -> DataFrame:
    """Compact state per key: row count, and per measure count, sum, minimum and maximum."""
    aggs = [F.count(F.lit(1)).alias(f"{prefix}_rows")]
    for name in measures:
        aggs += [F.count(name).alias(f"{prefix}_{name}_n"), F.sum(name).alias(f"{prefix}_{name}_sum"), F.min(name).alias(f"{prefix}_{name}_min"), F.max(name).alias(f"{prefix}_{name}_max")]
    return df.groupBy("key_field", "key_value").agg(*aggs)


def eager_join_profile(
    left: DataFrame,
    right: DataFrame,
    left_keys: Mapping[str, Column],
    right_keys: Mapping[str, Column],
    left_measures: Mapping[str, Column] | None = None,
    right_measures: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per (key_field, key_value) the aggregates of the inner join of two inputs.

    Keys are compared trimmed and lower-cased. Every key of ``left`` comes out;
    ``joined_rows`` is the number of pairs the join of raw rows would give (0
    where the right side lacks the key), ``joined_<m>_sum`` the sum of a left
    measure over those pairs, and for a right measure likewise.

    Nulls: a null key belongs to no group; a null measure counts in no sum, and
    a key without any value has a null sum, minimum and maximum. The empty
    string is a value like any other. Repeated rows count as often as they
    occur. Empty inputs give an empty result. Columns of the inputs that are not
    named here, whatever they are called, are not touched.
    """
    lm, rm = dict(left_measures or {}), dict(right_measures or {})
    norm = lambda ks: {n: plain_key(c.cast("string")) for n, c in ks.items()}
    l_states = states(unpivot_keys(left, norm(left_keys), lm), lm, "left")
    r_states = states(unpivot_keys(right, norm(right_keys), rm), rm, "right")
    both = l_states.join(r_states, ["key_field", "key_value"], "left").withColumn("right_rows", F.coalesce("right_rows", F.lit(0).cast("bigint")))
    out = both.withColumn("joined_rows", F.col("left_rows") * F.col("right_rows"))
    for m in lm:
        out = out.withColumn(f"joined_left_{m}_sum", F.col(f"left_{m}_sum") * F.col("right_rows"))
    for m in rm:
        out = out.withColumn(f"joined_right_{m}_sum", F.col(f"right_{m}_sum") * F.col("left_rows"))
    return out


def roll_up(profile: DataFrame) -> DataFrame:
    """Totals per key field of an ``eager_join_profile``: its states add up without the raw rows."""
    return profile.groupBy("key_field").agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("left_rows").alias("left_rows"),
        F.sum("right_rows").alias("right_rows"),
        F.sum("joined_rows").alias("joined_rows"),
        F.max("left_rows").alias("largest_key_rows"),
    )


def heavy_keys(profile: DataFrame, total_rows: int, least_share: float = 0.02) -> DataFrame:
    """Keys that hold at least ``least_share`` of ``total_rows`` rows of the left input.

    Write the profile first where its other results are wanted too: asked for
    these two columns alone, the planner leaves the right input out.
    """
    return profile.filter(F.col("left_rows") >= F.lit(least_share) * F.lit(total_rows)).select("key_field", "key_value")
