"""Profiles of users and threads, roll-ups and contrasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import safe_div
from threadloom.operators.records import EARLY, cue, dominant, entropy_by, in_order
from threadloom.runtime import Scratch

HIGH_PARTICIPATION = 20


def _n(c) -> F.Column:
    return F.coalesce(F.sum(c.cast("bigint")), F.lit(0))


def user_profiles(recs: DataFrame) -> DataFrame:
    """Per author: counts, distinct subreddits, groups and threads, entropies, dominant values, cross flags."""
    r = recs.filter(F.col("author").isNotNull())
    base = r.groupBy("author").agg(
        F.count(F.lit(1)).alias("comments"), F.sum("pred").alias("corrections"), F.count_distinct("subreddit").alias("subreddits"), F.count_distinct("grp").alias("groups"), F.count_distinct("submission_id").alias("threads")
    )
    parts = [base, entropy_by(r, ["author"], "subreddit", "subreddit_entropy"), entropy_by(r, ["author"], "grp", "group_entropy"), dominant(r, ["author"], "subreddit", "dominant_subreddit"), dominant(r, ["author"], "grp", "dominant_group")]
    u = reduce(lambda a, b: a.join(b, "author"), parts)
    return u.withColumns({"cross_subreddit": (F.col("subreddits") > 1).cast("int"), "cross_group": (F.col("groups") > 1).cast("int"), "correction_rate": safe_div(F.col("corrections"), F.col("comments"))})


def audience(recs: DataFrame, users: DataFrame, prefix: str) -> DataFrame:
    """Per thread: how mixed its distinct authors are."""
    a = recs.filter(F.col("author").isNotNull()).select("submission_id", "author").distinct().join(users, "author")
    base = a.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias(f"{prefix}_authors"), safe_div(F.sum("cross_group"), F.count(F.lit(1))).alias(f"{prefix}_cross_group_share"), safe_div(F.sum("cross_subreddit"), F.count(F.lit(1))).alias(f"{prefix}_cross_subreddit_share"),
        F.avg("group_entropy").alias(f"{prefix}_mean_group_entropy"), F.avg("subreddit_entropy").alias(f"{prefix}_mean_subreddit_entropy"),
    )
    return base.join(entropy_by(a, ["submission_id"], "dominant_group", f"{prefix}_dominant_group_entropy"), "submission_id").join(entropy_by(a, ["submission_id"], "dominant_subreddit", f"{prefix}_dominant_subreddit_entropy"), "submission_id")


def raw_thread_profiles(comments: DataFrame) -> DataFrame:
    """Per thread from raw comments: only rows with an author count as candidates; authors are not cleaned."""
    who = F.when(F.trim("author") != "", F.trim("author"))
    is_c = F.coalesce(F.col("candidate_correction"), F.lit(False))
    t = comments.filter(F.trim(F.coalesce("submission_id", F.lit(""))) != "").groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("comments"), F.count_distinct(who).alias("authors"), F.count_if(is_c & who.isNotNull()).alias("candidates"), F.count_distinct(F.when(is_c, who)).alias("correctors")
    )
    return t.withColumn("exposed", F.greatest(F.col("authors") - F.col("correctors"), F.lit(0))).withColumn("candidate_rate", safe_div(F.col("candidates"), F.col("comments")))


def thread_profiles(recs: DataFrame, early_n: int = EARLY, high: int = HIGH_PARTICIPATION) -> DataFrame:
    """Per thread: counts, rates, early and later halves, first correction, attributes of its first comment."""
    r = in_order(recs)
    early, later, p = F.col("rank") <= early_n, F.col("rank") > early_n, F.col("pred") == 1
    t = r.groupBy("submission_id").agg(
        F.min_by("subreddit", "rank").alias("subreddit"), F.min_by("grp", "rank").alias("grp"), F.count(F.lit(1)).alias("comments"), F.count_distinct("author").alias("authors"),
        F.sum("candidate").alias("candidates"), F.sum("pred").alias("corrections"), F.count_distinct(F.when(p, F.col("author"))).alias("correctors"), F.max("score").alias("max_score"),
        F.count_if(later).alias("later_comments"), _n(F.when(later, F.col("pred"))).alias("later_corrections"), F.count_distinct(F.when(later & p, F.col("author"))).alias("later_correctors"),
        F.sum("hostile").alias("hostile"), F.sum("anti").alias("anti"), F.count_if(early).alias("early_comments"), _n(F.when(early, F.col("pred"))).alias("early_corrections"),
        _n(F.when(early, F.col("hostile"))).alias("early_hostile"), _n(F.when(early, F.col("anti"))).alias("early_anti"), F.coalesce(F.min(F.when(p, F.col("rank"))), F.lit(0)).alias("first_correction_rank"),
    )
    return t.withColumns({
        "correction_rate": safe_div(F.col("corrections"), F.col("comments")), "author_rate": safe_div(F.col("correctors"), F.col("authors")), "later_correction_rate": safe_div(F.col("later_corrections"), F.col("later_comments")),
        "exposed": F.greatest(F.col("authors") - F.col("correctors"), F.lit(0)), "high_without_correction": ((F.col("authors") >= high) & (F.col("corrections") == 0)).cast("int"),
        "hostility_rate": safe_div(F.col("hostile"), F.col("comments")), "anti_rate": safe_div(F.col("anti"), F.col("comments")),
        "early_hostility_rate": safe_div(F.col("early_hostile"), F.col("early_comments")), "early_anti_rate": safe_div(F.col("early_anti"), F.col("early_comments")),
    })


def reply_profiles(recs: DataFrame) -> DataFrame:
    """Per thread: replies to corrections, the hostile ones, and corrections that met one."""
    corr = recs.filter(F.col("pred") == 1).select(F.col("comment_id").alias("parent_id"), F.col("submission_id").alias("parent_thread"))
    hit = recs.join(corr, "parent_id")
    own = (F.col("hostile") == 1) & (F.col("parent_thread") == F.col("submission_id"))
    t = hit.groupBy("submission_id").agg(F.count(F.lit(1)).alias("replies"), F.sum("hostile").alias("hostile_replies"), F.count_distinct(F.when(own, F.col("parent_id"))).alias("corrections_hit"))
    return t.withColumn("hostile_reply_rate", safe_div(F.col("hostile_replies"), F.col("replies")))


def cue_entropies(recs: DataFrame, early_n: int = EARLY) -> DataFrame:
    r = in_order(recs).withColumn("cue", cue())
    return entropy_by(r, ["submission_id"], "cue", "cue_entropy").join(entropy_by(r.filter(F.col("rank") <= early_n), ["submission_id"], "cue", "early_cue_entropy"), "submission_id")


def climate(recs: DataFrame, early_n: int = EARLY) -> DataFrame:
    """The full thread climate profile."""
    users = Scratch(recs.sparkSession, "users").keep(user_profiles(recs))
    t = thread_profiles(recs, early_n)
    parts = [cue_entropies(recs, early_n), reply_profiles(recs), audience(recs, users, "audience"), audience(in_order(recs).filter(F.col("rank") <= early_n), users, "early_audience")]
    out = reduce(lambda a, b: a.join(b, "submission_id", "left"), parts, t)
    return out.fillna(0, [c for b in parts for c in b.columns if c != "submission_id"])


FLAGGED = ("hostility_rate", "anti_rate", "early_hostility_rate", "early_anti_rate", "early_audience_cross_group_share", "audience_cross_group_share", "early_cue_entropy", "cue_entropy")


def climate_flags(threads: DataFrame, min_comments: int = 5, q: float = 0.75) -> DataFrame:
    """Adds high_<measure>: among threads of enough comments, at or above the nearest-rank quantile and above 0."""
    ok = F.col("comments") >= min_comments
    cut = threads.filter(ok).agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {c})").alias(f"_{c}") for c in FLAGGED])
    flagged = threads.join(F.broadcast(cut))  # one row
    return flagged.select(*threads.columns, *[(ok & (F.col(c) >= F.col(f"_{c}")) & (F.col(c) > 0)).cast("int").alias(f"high_{c}") for c in FLAGGED])


def roll_up(threads: DataFrame, key: str) -> DataFrame:
    """Sums, then ratios of sums; a null key is ``unknown``."""
    t = threads.groupBy(F.coalesce(F.col(key), F.lit("unknown")).alias(key)).agg(
        F.count(F.lit(1)).alias("threads"), F.sum("comments").alias("comments"), F.sum("authors").alias("author_instances"), F.sum("corrections").alias("corrections"), F.sum("correctors").alias("corrector_instances"),
        F.count_if(F.col("corrections") > 0).alias("threads_with_correction"), F.sum("hostile").alias("hostile"), F.avg("hostility_rate").alias("hostility_rate_mean"),
    )
    return t.withColumns({"correction_rate": safe_div(F.col("corrections"), F.col("comments")), "author_rate": safe_div(F.col("corrector_instances"), F.col("author_instances")), "thread_share": safe_div(F.col("threads_with_correction"), F.col("threads"))})


def instances(recs: DataFrame, early_n: int = EARLY) -> DataFrame:
    """Per thread and author: comments and corrections, early and later, with user attributes."""
    r = in_order(recs).filter(F.col("author").isNotNull())
    later = F.col("rank") > early_n
    i = r.groupBy("submission_id", "author").agg(
        F.min_by("grp", "rank").alias("grp"), F.min_by("subreddit", "rank").alias("subreddit"), F.count(F.lit(1)).alias("comments"), F.sum("pred").alias("corrections"),
        F.count_if(later).alias("later_comments"), _n(F.when(later, F.col("pred"))).alias("later_corrections"),
    )
    i = i.withColumns({"corrected": (F.col("corrections") > 0).cast("int"), "later_corrected": (F.col("later_corrections") > 0).cast("int")})
    u = user_profiles(recs).select("author", "cross_group", "cross_subreddit")
    return i.join(u, "author")


def instance_sets(inst: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Instances, positives, comments and rates for several key sets in one pass (grouping sets)."""
    keys = sorted({k for s in sets for k in s})
    g = inst.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.grouping_id().cast("bigint").alias("set_id"), F.count(F.lit(1)).alias("instances"), F.sum("corrected").alias("positives"), F.sum("comments").alias("comments"), F.sum("corrections").alias("corrections")
    )
    return g.withColumns({"rate": safe_div(F.col("positives"), F.col("instances")), "intensity": safe_div(F.col("corrections"), F.col("comments"))})


def cross_contrasts(inst: DataFrame, flags: tuple[str, ...] = ("cross_group", "cross_subreddit")) -> DataFrame:
    """Per flag and context (all, each group): rates with and without the flag and their difference; empty cells as 0."""
    long = inst.select("corrected", "grp", F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("on")) for f in flags])).alias("_f")).select("corrected", "_f.*", F.explode(F.array(F.lit("all"), F.concat(F.lit("group:"), F.col("grp")))).alias("context"))
    cell = lambda v, c: F.coalesce(F.sum(F.when(F.col("on") == v, c)), F.lit(0))
    g = long.groupBy("flag", "context").agg(cell(1, F.lit(1)).alias("n_with"), cell(1, F.col("corrected")).alias("positives_with"), cell(0, F.lit(1)).alias("n_without"), cell(0, F.col("corrected")).alias("positives_without"))
    g = g.withColumns({"rate_with": safe_div(F.col("positives_with"), F.col("n_with")), "rate_without": safe_div(F.col("positives_without"), F.col("n_without"))})
    return g.withColumn("difference", F.col("rate_with") - F.col("rate_without"))


def noisy_or(recs: DataFrame, early_n: int = EARLY) -> DataFrame:
    """Per thread and author: sum, maximum and 1 - prod(1 - score), over all and over later comments."""
    s = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    later = F.when(F.col("rank") > early_n, s)
    return in_order(recs).filter(F.col("author").isNotNull()).groupBy("submission_id", "author").agg(
        F.sum(s).alias("score_sum"), F.max(s).alias("score_max"), (1 - F.product(1 - s)).alias("score_any"),
        F.coalesce(F.sum(later), F.lit(0.0)).alias("later_sum"), F.coalesce(F.max(later), F.lit(0.0)).alias("later_max"), (1 - F.coalesce(F.product(1 - later), F.lit(1.0))).alias("later_any"),
    )
