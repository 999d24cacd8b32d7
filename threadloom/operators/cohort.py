"""Early contexts, later entrants and their first responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import safe_div
from threadloom.operators.history import DAY, pair_history
from threadloom.operators.records import EARLY, in_order
from threadloom.runtime import Scratch


def context_split(recs: DataFrame, window: str = "comments", value: float = EARLY, horizon_days: float = 7.0) -> DataFrame:
    """Rows within the horizon with ``side`` early or later and the cutoff, of threads with both sides.

    ``comments``: early are the first n; later ones come strictly after the time of
    the n-th, so rows that share its second are on neither side. ``hours``: early
    up to the cutoff, later after it.
    """
    r = in_order(recs.filter(F.col("author").isNotNull())).filter(F.col("created_utc") <= F.col("thread_start") + horizon_days * DAY)
    if window == "comments":
        n = int(value)
        cut = F.max(F.when(F.col("rank") == n, F.col("created_utc")))
        side = F.when(F.col("rank") <= n, "early").when(F.col("created_utc") > F.col("cutoff"), "later")
    elif window == "hours":
        if value * 3600.0 >= horizon_days * DAY:
            return r.limit(0).withColumns({"cutoff": F.lit(None).cast("double"), "side": F.lit(None).cast("string")})
        cut = F.min("thread_start") + value * 3600.0
        side = F.when(F.col("created_utc") <= F.col("cutoff"), "early").otherwise("later")
    else:
        raise ValueError(f"unknown window {window}")
    # Cutoffs and the last row's time are aggregates joined back, one row a thread: no window holds a thread.
    per = r.groupBy("submission_id").agg(cut.alias("cutoff"), F.max("created_utc").alias("_end"), F.min("created_utc").alias("_begin"))
    both = per.filter(F.col("cutoff").isNotNull() & (F.col("_end") > F.col("cutoff")) & (F.col("_begin") <= F.col("cutoff")))
    return r.join(both.select("submission_id", "cutoff"), "submission_id").withColumn("side", side).filter(F.col("side").isNotNull())


def early_features(split: DataFrame, history: DataFrame, window: str = "comments") -> DataFrame:
    """Per thread: what its early rows were like."""
    e = split.filter(F.col("side") == "early")
    fixed = e.select(F.col("submission_id"), F.col("comment_id").alias("parent_id"), (F.col("pred") == 1).alias("_to_corr")).filter("_to_corr")
    e = e.join(fixed, ["submission_id", "parent_id"], "left").withColumn("reply", F.coalesce("_to_corr", F.lit(False)).cast("int"))
    who = e.select("submission_id", "author").distinct().join(history.select("submission_id", "author", "prior_cross_group", "prior_eligible"), ["submission_id", "author"], "left")
    share = who.groupBy("submission_id").agg(F.count(F.lit(1)).alias("early_authors"), F.avg(F.coalesce("prior_cross_group", F.lit(0))).alias("early_cross_share"), F.avg(F.coalesce("prior_eligible", F.lit(0))).alias("early_history_coverage"))
    hours = F.greatest((F.max("cutoff") - F.max("thread_start")) / 3600.0, F.lit(0.0))
    f = e.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("early_comments"), (F.max("pred") > 0).cast("int").alias("early_presence"), F.avg("pred").alias("early_rate"), F.avg((F.col("hostile") == 1).cast("int") * (1 - F.col("reply"))).alias("early_ambient_hostility"),
        F.max("reply").alias("early_reply_presence"), F.max((F.col("hostile") == 1).cast("int") * F.col("reply")).alias("early_directed_presence"), F.avg((F.col("hostile") == 1).cast("int") * F.col("reply")).alias("early_directed_rate"),
        F.avg((F.col("pair_count") > 0).cast("int")).alias("early_candidate_share"), hours.alias("early_hours"),
    )
    activity = F.log1p("early_hours") if window == "comments" else F.log1p("early_comments")
    return f.join(share, "submission_id").withColumn("early_activity", activity)


def first_responses(split: DataFrame) -> DataFrame:
    """The first later row of each author who was not early in the thread."""
    early = split.filter(F.col("side") == "early").select("submission_id", "author").distinct()
    late = split.filter(F.col("side") == "later").join(early, ["submission_id", "author"], "left_anti")
    cols = [c for c in late.columns if c not in ("submission_id", "author")]
    one = late.groupBy("submission_id", "author").agg(F.min_by(F.struct(*cols), F.struct("created_utc", "comment_id")).alias("_r"))
    return one.select("submission_id", "author", "_r.*")


def cohort(recs: DataFrame, window: str = "comments", value: float = EARLY, horizon_days: float = 7.0, min_prior: int = 2, min_days: float = 7.0, history: DataFrame | None = None) -> DataFrame:
    """The analysis frame: first responses of later entrants with early context and own history (``history``: of the same records, written before)."""
    scratch = Scratch(recs.sparkSession, "cohort")
    history = scratch.keep(pair_history(recs)) if history is None else history
    split = scratch.keep(context_split(recs, window, value, horizon_days))
    first = first_responses(split).select(
        "submission_id", "author", "comment_id", "subreddit", "grp", F.col("pred").alias("response"), F.col("score").alias("response_score"), F.col("pair_count").alias("response_pairs"), F.col("words").alias("response_words"),
        ((F.col("created_utc") - F.col("thread_start")) / 3600.0).alias("delay_hours"),
    )
    keep = history.filter((F.col("prior_comments") >= min_prior) & (F.col("history_days") >= min_days)).drop("thread_start")
    return first.join(keep, ["submission_id", "author"]).join(early_features(split, history, window), "submission_id")


def funnel(recs: DataFrame, window: str = "comments", value: float = EARLY, horizon_days: float = 7.0, min_prior: int = 2, min_days: float = 7.0) -> DataFrame:
    """stage, rows: how many threads and responses each step leaves."""
    r = recs.filter(F.col("author").isNotNull())
    split = Scratch(recs.sparkSession, "funnel").keep(context_split(recs, window, value, horizon_days))
    first = first_responses(split)
    history = pair_history(recs).select("submission_id", "author", "prior_comments", "history_days")
    ok = (F.col("prior_comments") >= min_prior) & (F.col("history_days") >= min_days)
    stages = [
        r.agg(F.count_distinct("submission_id").alias("rows")).select(F.lit("source_threads").alias("stage"), "rows"),
        r.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("source_comments").alias("stage"), "rows"),
        split.agg(F.count_distinct("submission_id").alias("rows")).select(F.lit("threads_with_both_sides").alias("stage"), "rows"),
        first.agg(F.count_distinct("submission_id").alias("rows")).select(F.lit("threads_with_entrants").alias("stage"), "rows"),
        first.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("first_responses").alias("stage"), "rows"),
        first.join(history, ["submission_id", "author"]).agg(F.count_if(ok).alias("rows")).select(F.lit("analysis_responses").alias("stage"), "rows"),
    ]
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    return out


def continuation(recs: DataFrame, window: str = "comments", value: float = EARLY, horizon_days: float = 7.0) -> DataFrame:
    """Per early author: whether they came back later, and what the other early authors did (totals minus own)."""
    split = context_split(recs, window, value, horizon_days)
    own = split.groupBy("submission_id", "author").agg(F.count_if(F.col("side") == "early").alias("own_early"), F.sum(F.when(F.col("side") == "early", F.col("pred")).otherwise(0)).alias("own_corrections"), F.max((F.col("side") == "later").cast("int")).alias("returned"))
    own = own.filter("own_early > 0")
    tot = own.groupBy("submission_id").agg(F.sum("own_early").alias("_n"), F.sum("own_corrections").alias("_c"))
    o = own.join(tot, "submission_id").withColumns({"others_early": F.col("_n") - F.col("own_early"), "others_corrections": F.col("_c") - F.col("own_corrections")})
    return o.withColumn("others_rate", safe_div(F.col("others_corrections"), F.col("others_early"))).drop("_n", "_c")


def early_variants(recs: DataFrame, n: int = EARLY) -> DataFrame:
    """Threads with at least n comments: counts, first position, earliness and score statistics of the first n."""
    r = in_order(recs).filter(F.col("rank") <= n)
    p = F.col("pred") == 1
    t = r.groupBy("submission_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("pred").alias("corrections"), F.min(F.when(p, F.col("rank"))).alias("first_position"), F.avg("score").alias("score_mean"), F.max("score").alias("score_max"), F.stddev_pop("score").alias("score_sd"))
    return t.filter(F.col("rows") == n).withColumn("earliness", F.when(F.col("first_position").isNotNull(), 1 - (F.col("first_position") - 1) / n)).drop("rows")


def window_distribution(recs: DataFrame, at: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Per thread: hours to the n-th comment and the duration."""
    r = in_order(recs)
    hours = lambda c: (c - F.min("thread_start")) / 3600.0
    return r.groupBy("submission_id").agg(*[hours(F.max(F.when(F.col("rank") == k, F.col("created_utc")))).alias(f"hours_to_{k}") for k in at], hours(F.max("created_utc")).alias("duration_hours"))
