"""Comments with their predictions, in one notation, and their order in threads and over authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import lexicon, text
from threadloom.functions.keys import author, plain_id, plain_key
from threadloom.runtime import cut_hot

EARLY = 10


def comment_records(comments: DataFrame) -> DataFrame:
    """One row per comment id; where rows of an id differ, the greatest value of a column."""
    c = comments.select(
        plain_id(F.col("comment_id")).alias("comment_id"), plain_id(F.col("submission_id")).alias("submission_id"), plain_id(F.col("parent_id")).alias("parent_id"),
        author(F.col("author")).alias("author"), F.coalesce(plain_key(F.col("subreddit")), F.lit("unknown")).alias("subreddit"),
        F.col("created_utc").cast("double").alias("created_utc"), "body", F.col("submission_title").alias("title"), F.col("candidate_correction").cast("int").alias("candidate"),
    )
    cols = [x for x in c.columns if x != "comment_id"]
    return c.filter(F.col("comment_id").isNotNull()).groupBy("comment_id").agg(*[F.max(x).alias(x) for x in cols])


def predictions(frame: DataFrame) -> DataFrame:
    """One row per comment id: grp, score, pred, pair_count, best_pair."""
    p = frame.select(
        plain_id(F.col("comment_id")).alias("comment_id"), F.coalesce(plain_key(F.col("community_group_proxy")), F.lit("unknown")).alias("grp"),
        F.coalesce(F.col("public_correction_score"), F.lit(0.0)).alias("score"), F.coalesce(F.col("public_correction_pred"), F.lit(0)).cast("bigint").alias("pred"),
        F.coalesce(F.col("pair_relation_candidate_count"), F.lit(0)).cast("bigint").alias("pair_count"), F.col("pair_relation_best_pair_id").alias("best_pair"),
    )
    return p.groupBy("comment_id").agg(*[F.max(x).alias(x) for x in p.columns if x != "comment_id"])


def records(comments: DataFrame, preds: DataFrame) -> DataFrame:
    """Predicted comments with thread and time: the frame that profiles and cohorts start from.

    Inner join on the comment id. Rows without thread or time are left out. Flags
    are 0 or 1; null authors stand for removed ones.
    """
    r = comment_records(comments).join(predictions(preds), "comment_id").filter(F.col("submission_id").isNotNull() & F.col("created_utc").isNotNull())
    return r.select(
        "comment_id", "submission_id", "parent_id", "author", "subreddit", "grp", "created_utc", "body", "title", F.coalesce("candidate", F.lit(0)).cast("bigint").alias("candidate"),
        "score", "pred", "pair_count", "best_pair", text.word_count(F.col("body")).alias("words"),
        lexicon.has_term(F.col("body"), lexicon.HOSTILITY).cast("bigint").alias("hostile"), lexicon.has_term(F.col("body"), lexicon.ANTI_INSTITUTIONAL).cast("bigint").alias("anti"),
    )


def in_order(frame: DataFrame) -> DataFrame:
    """Adds rank (from 1 within the thread by time, then id) and thread_start.

    A window per thread; a thread that holds much of the table is cut into
    slices of about equal counts, even if all of it lies within a day or a
    second, and the running counts of its slices are added. Give a written table.
    """
    f, several = cut_hot(frame, "submission_id", ["created_utc", "comment_id"])
    thread = Window.partitionBy("submission_id")
    if not several:
        rank = F.row_number().over(thread.orderBy("created_utc", "comment_id"))
        return frame.select(*[F.col(c) for c in frame.columns], rank.cast("bigint").alias("rank"), F.min("created_utc").over(thread).alias("thread_start"))
    per = f.groupBy("submission_id", "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("created_utc").alias("_first"))
    before = F.coalesce(F.sum("_n").over(thread.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select("submission_id", "_slice", before.alias("_before"), F.min("_first").over(thread).alias("thread_start"))
    inner = F.row_number().over(Window.partitionBy("submission_id", "_slice").orderBy("created_utc", "comment_id"))
    ranked = f.withColumn("_k", inner).join(offsets, ["submission_id", "_slice"])
    return ranked.select(*[F.col(c) for c in frame.columns], (F.col("_k") + F.col("_before")).alias("rank"), "thread_start")


def cue() -> F.Column:
    """correction, anti_institutional, hostility or other, in that order of precedence."""
    return F.when(F.col("pred") == 1, "correction").when(F.col("anti") == 1, "anti_institutional").when(F.col("hostile") == 1, "hostility").otherwise("other")


def entropy_by(frame: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Per ``keys`` the natural entropy of the counts of ``value``."""
    n = frame.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    # sum of n ln n and sum of n give the entropy without a second pass.
    agg = n.groupBy(*keys).agg(F.sum(F.col("_n") * F.ln("_n")).alias("_s"), F.sum("_n").alias("_t"))
    return agg.select(*keys, (F.ln("_t") - F.col("_s") / F.col("_t")).alias(name))


def dominant(frame: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Per ``keys`` the most frequent value; ties go to the one seen first."""
    n = frame.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("created_utc", "comment_id")).alias("_first"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(name))
