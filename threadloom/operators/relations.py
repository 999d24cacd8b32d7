"""Relation vectors of comments, what they say of a thread's opening, and the analysis frame.

The tables hold no class probabilities, so a comment's vector over nine classes
is derived by a documented rule: its correction score is shared equally among the
classes whose cue it shows (``other`` if it shows none), and what is left of 1
is the probability of no relation. Any classifier's probabilities can take the
columns' place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators.metrics import standardise
from threadloom.operators.records import EARLY, in_order

# Classes in order; the first five are the corrective ones.
TYPES = ("denial", "evidence", "quotation", "elaboration", "question", "institutions", "hostility", "other")
CORRECTIVE = 5
COLUMNS = tuple(f"rel_{t}" for t in TYPES)


def with_relations(recs: DataFrame) -> DataFrame:
    """Adds rel_<class> and rel_none (sum 1), and ``rel_available``: whether the comment has candidate pairs."""
    b = F.col("body")
    cues = {
        "denial": F.col("candidate") == 1, "evidence": text.has_number(b) == 1, "quotation": text.has_quote(b) == 1, "elaboration": F.col("words") >= 50,
        "question": F.contains(F.coalesce(b, F.lit("")), F.lit("?")), "institutions": F.col("anti") == 1, "hostility": F.col("hostile") == 1,
    }
    on = {n: F.coalesce(c, F.lit(False)).cast("int") for n, c in cues.items()}
    count = sum(on.values(), F.lit(0))
    on["other"] = (count == 0).cast("int")
    score = text.clip(F.col("score"))
    r = recs.withColumns({f"_on_{t}": on[t] for t in TYPES}).withColumn("_n", F.greatest(count, F.lit(1)))
    return r.withColumns({f"rel_{t}": score * F.col(f"_on_{t}") / F.col("_n") for t in TYPES} | {"rel_none": 1 - score, "rel_available": (F.col("pair_count") > 0).cast("int")}).drop("_n", *[f"_on_{t}" for t in TYPES])


def _share(values: Column, k: int) -> Column:
    """Entropy of weights relative to that of k equal ones; 0 for none."""
    return text.entropy_of(values) / math.log(k)


def early_relations(split: DataFrame) -> DataFrame:
    """Per thread over its early rows: relation diversity (of the mean vector as it is), coverage, further corrections."""
    mean = F.array(*[F.avg(c) for c in (*COLUMNS, "rel_none")])
    e = split.filter(F.col("side") == "early").groupBy("submission_id").agg(mean.alias("_m"), F.avg("rel_available").alias("early_relation_coverage"), F.greatest(F.sum("pred") - 1, F.lit(0)).cast("bigint").alias("early_additional"))
    return e.select("submission_id", (text.entropy_as_is(F.col("_m")) / math.log(len(TYPES) + 1)).alias("early_relation_diversity"), "early_relation_coverage", "early_additional")


def early_relation_variants(recs: DataFrame, n: int = EARLY) -> DataFrame:
    """Threads with at least n comments: other measures of the first n, soft, hard and of relations alone.

    A comment's hard class is the first greatest of its vector. Measures of
    relations alone take only comments with candidate pairs and leave ``rel_none`` out.
    """
    whole, own = F.array(*COLUMNS, "rel_none"), F.array(*COLUMNS)
    r = in_order(recs).filter(F.col("rank") <= n).withColumns({"_hard": text.argmax(whole), "_own": F.when(F.col("rel_available") == 1, text.argmax(own))})
    first = F.min(F.when(F.col("pred") == 1, F.col("rank")))
    t = r.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.avg(c).alias(f"early_mean_{c[4:]}") for c in (*COLUMNS, "rel_none")], F.array(*[F.coalesce(F.avg(F.when(F.col("rel_available") == 1, F.col(c))), F.lit(0.0)) for c in COLUMNS]).alias("_alone"),
        F.array(*[F.count_if(F.col("_hard") == k).cast("double") for k in range(len(TYPES) + 1)]).alias("_counts"), F.count_distinct("_own").alias("relation_only_richness"), F.count_distinct("_hard").alias("hard_richness"),
        F.sum("pred").alias("corrections"), F.greatest(F.sum("pred") - 1, F.lit(0)).cast("bigint").alias("additional_corrections"), F.coalesce(first, F.lit(0)).cast("bigint").alias("first_position"),
        ((n - first) / (n - 1)).alias("correction_earliness"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.avg("pair_count").alias("mean_candidates"),
    ).filter(F.col("_rows") == n)
    mean = [F.col(f"early_mean_{t}") for t in TYPES]
    soft = F.array(*mean, "early_mean_none")
    return t.withColumns({
        "soft_diversity": text.entropy_as_is(soft) / math.log(len(TYPES) + 1), "soft_renormalised": _share(soft, len(TYPES) + 1), "hard_diversity": _share(F.col("_counts"), len(TYPES) + 1), "relation_only_diversity": _share(F.col("_alone"), len(TYPES)),
        "corrective_diversity": _share(F.array(*mean[:CORRECTIVE]), CORRECTIVE), "other_diversity": _share(F.array(*mean[CORRECTIVE:]), len(TYPES) - CORRECTIVE),
    }).drop("_rows", "_alone", "_counts", "early_mean_none")


#: Columns of the analysis frame that get a standardised companion.
STANDARDISED = ("log_prior", "prior_rate", "early_rate", "early_ambient_hostility", "early_directed_rate", "early_cross_share", "early_history_coverage", "early_candidate_share", "early_activity", "early_relation_diversity", "early_relation_coverage")


def access_pattern(cross_subreddit: Column, cross_group: Column) -> Column:
    return F.when(cross_group == 1, "across_groups").when(cross_subreddit == 1, "across_subreddits").otherwise("one_subreddit")


def participation(prior_comments: Column, cross_subreddit: Column) -> Column:
    return F.when(prior_comments < 2, "limited prior record").when(cross_subreddit == 1, "multiple prior subreddits").otherwise("one prior subreddit")


def analysis_frame(cohort: DataFrame, relations: DataFrame) -> DataFrame:
    """The cohort with relation features, logs, caps, cases and standardised columns (<c>_z)."""
    f = cohort.join(relations, "submission_id").withColumns({
        "log_prior": F.log1p("prior_comments"), "log_delay": F.log1p("delay_hours"), "log_words": F.log1p("response_words"), "prior_groups_capped": F.least("prior_groups", F.lit(3)).cast("bigint"), "prior_subreddits_capped": F.least("prior_subreddits", F.lit(4)).cast("bigint"),
        "access_pattern": access_pattern(F.col("prior_cross_subreddit"), F.col("prior_cross_group")), "participation": participation(F.col("prior_comments"), F.col("prior_cross_subreddit")),
        "hostile_opening": F.when(F.col("early_ambient_hostility") + F.col("early_directed_rate") > 0, "any hostile language").otherwise("no hostile language"),
    })
    return standardise(f, list(STANDARDISED))
