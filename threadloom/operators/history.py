"""Point-in-time author histories and thread contexts, without inequality joins.

What an author did strictly before a thread began is an as-of aggregate. Probes
(author, thread start) and events (author, time) are laid on one time line per
author, probes before events of the same second; a running sum then gives every
probe what came before it. Distinct counts become running sums of flags on first
occurrences. An author with many of all events is cut into slices of about equal
counts: within a slice the running sums are windows, and slice totals, of which there
are few, carry the rest.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import entropy_of, safe_div
from threadloom.operators.records import EARLY, in_order
from threadloom.runtime import cut_hot

DAY = 86400.0


def before(probes: DataFrame, events: DataFrame, key: str, at: str, time: str, sums: Mapping[str, Column], source: DataFrame) -> DataFrame:
    """``probes`` with the sums of the key's events strictly before ``at``; 0 where there are none.

    Windows within (key, slice), and running sums of slice totals where keys are
    cut. source: a written table with ``key`` and ``created_utc`` by which hot keys are cut.
    """
    names = list(sums)
    line_p = probes.select(*probes.columns, F.col(at).alias("_t"), F.lit(0).alias("_kind"), *[F.lit(0.0).alias(f"_{n}") for n in names])
    line_e = events.select(F.col(key), F.col(time).alias("_t"), F.lit(1).alias("_kind"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_{n}") for n, c in sums.items()])
    line = line_p.unionByName(line_e, allowMissingColumns=True)
    line, several = cut_hot(line, key, ["_t", "_kind"], source.select(key, F.col("created_utc").alias("_t"), F.lit(1).alias("_kind")))
    w = Window.partitionBy(key, "_slice").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    inner = line.select("*", *[F.coalesce(F.sum(f"_{n}").over(w), F.lit(0.0)).alias(f"_in_{n}") for n in names]).filter(F.col("_kind") == 0)
    if not several:
        return inner.select(*[F.col(c) for c in probes.columns], *[F.col(f"_in_{n}").alias(n) for n in names])
    totals = line.groupBy(key, "_slice").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in names])
    back = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "_slice", *[F.coalesce(F.sum(f"_{n}").over(back), F.lit(0.0)).alias(f"_c_{n}") for n in names])
    return inner.join(carried, [key, "_slice"]).select(*[F.col(c) for c in probes.columns], *[(F.col(f"_in_{n}") + F.col(f"_c_{n}")).alias(n) for n in names])


def first_of(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``_new``: 1 on the earliest row of each combination of ``keys`` (by time, then id)."""
    first = frame.groupBy(*keys).agg(F.min(F.struct("created_utc", "comment_id")).alias("_first"))
    flagged = frame.join(first, keys).withColumn("_new", (F.struct("created_utc", "comment_id") == F.col("_first")).cast("int"))
    return flagged.drop("_first")


def pair_history(recs: DataFrame) -> DataFrame:
    """Per (submission, author): the author's comments, subreddits, groups and corrections before the thread began."""
    r = in_order(recs.filter(F.col("author").isNotNull()))
    probes = r.groupBy("submission_id", "author").agg(F.min("thread_start").alias("thread_start"))
    ev = first_of(first_of(r, ["author", "subreddit"]).withColumnRenamed("_new", "_new_sub"), ["author", "grp"]).withColumnRenamed("_new", "_new_grp")
    start = r.agg(F.min("created_utc").alias("_origin"))
    h = before(probes, ev, "author", "thread_start", "created_utc", {"prior_comments": F.lit(1), "prior_subreddits": F.col("_new_sub"), "prior_groups": F.col("_new_grp"), "prior_corrections": F.col("pred")}, recs)
    h = h.select("submission_id", "author", "thread_start", *[F.col(c).cast("bigint").alias(c) for c in ("prior_comments", "prior_subreddits", "prior_groups", "prior_corrections")]).join(F.broadcast(start))  # one row
    return h.withColumns({
        "prior_rate": safe_div(F.col("prior_corrections"), F.col("prior_comments")), "prior_cross_subreddit": (F.col("prior_subreddits") > 1).cast("int"), "prior_cross_group": (F.col("prior_groups") > 1).cast("int"),
        "prior_observed": (F.col("prior_comments") > 0).cast("int"), "prior_eligible": (F.col("prior_comments") >= 2).cast("int"), "history_days": F.greatest((F.col("thread_start") - F.col("_origin")) / DAY, F.lit(0.0)),
    }).drop("_origin")


def history_diversity(recs: DataFrame, groups: list[str]) -> DataFrame:
    """Per (submission, author): prior comments per group, their entropy (of ln k) and effective number of groups."""
    r = in_order(recs.filter(F.col("author").isNotNull()))
    probes = r.groupBy("submission_id", "author").agg(F.min("thread_start").alias("thread_start"))
    names = {f"group_{k}": (F.col("grp") == g) for k, g in enumerate(sorted(groups))}
    h = before(probes, r, "author", "thread_start", "created_utc", {n: c.cast("int") for n, c in names.items()}, recs)
    raw = entropy_of(F.array(*names))
    ln_k = F.lit(math.log(max(2, len(groups))))
    out = h.select("submission_id", "author", *[F.col(n).cast("bigint").alias(n) for n in names], (raw / ln_k).alias("group_entropy"), F.when(sum((F.col(n) for n in names), F.lit(0.0)) > 0, F.exp(raw)).otherwise(0.0).alias("effective_groups"))
    return out


def entry_contexts(recs: DataFrame, opening: int = EARLY) -> DataFrame:
    """Per (submission, author): what the author saw on entry: aggregates over the thread's rows before it, at most ``opening``.

    Running sums by rank, read off at rank min(position - 1, opening): one
    equi-join instead of a join of every entry with every earlier row.
    """
    r = in_order(recs)
    w = Window.partitionBy("submission_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = r.filter(F.col("rank") <= opening).select("submission_id", F.col("rank").alias("_at"), F.sum("pred").over(w).alias("seen_corrections"), F.sum("hostile").over(w).alias("seen_hostile"), F.sum("score").over(w).alias("seen_score"))
    entry = r.filter(F.col("author").isNotNull()).groupBy("submission_id", "author").agg(F.min("rank").alias("position"), F.min("created_utc").alias("entry_time"))
    entry = entry.withColumn("seen_comments", F.least(F.col("position") - 1, F.lit(opening)).cast("bigint"))
    e = entry.join(run.withColumnRenamed("_at", "seen_comments"), ["submission_id", "seen_comments"], "left")
    return e.select("submission_id", "author", "position", "entry_time", "seen_comments", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("seen_corrections", "seen_hostile")], F.coalesce("seen_score", F.lit(0.0)).alias("seen_score"))


def prior_contexts(recs: DataFrame, opening: int = EARLY) -> DataFrame:
    """Per (submission, author): ratios over the author's entries into other threads before this one began."""
    ev = entry_contexts(recs, opening)
    start = in_order(recs).groupBy("submission_id").agg(F.min("thread_start").alias("thread_start"))
    probes = ev.select("submission_id", "author").join(start, "submission_id")
    sums = {"prior_entries": F.lit(1), "_seen": F.col("seen_comments"), "_corr": F.col("seen_corrections"), "_host": F.col("seen_hostile"), "_with": (F.col("seen_corrections") > 0).cast("int"), "_opened": (F.col("position") == 1).cast("int")}
    h = before(probes, ev.select("author", "entry_time", "seen_comments", "seen_corrections", "seen_hostile", "position"), "author", "thread_start", "entry_time", sums, recs)
    return h.select(
        "submission_id", "author", F.col("prior_entries").cast("bigint").alias("prior_entries"), safe_div(F.col("_corr"), F.col("_seen")).alias("prior_seen_correction_rate"), safe_div(F.col("_host"), F.col("_seen")).alias("prior_seen_hostility_rate"),
        safe_div(F.col("_with"), F.col("prior_entries")).alias("prior_exposed_share"), safe_div(F.col("_opened"), F.col("prior_entries")).alias("prior_opened_share"), safe_div(F.col("_seen"), F.col("prior_entries")).alias("prior_mean_seen"),
    )
