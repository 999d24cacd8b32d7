"""Queries that hold a classifier's scores against labels, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import keys
from threadloom.operators import history, metrics, pairs, relations, simulation
from threadloom.operators.records import in_order
from threadloom.plans import discussion
from threadloom.plans.discussion import _TM, _TM2, _id, kept, recs
from threadloom.runtime import Scratch
from threadloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None, doubles: str = "", longs: str = ""):
    """As in ``discussion``, into this module's tables."""

    def register(f):
        run = discussion.query(sql, doubles, longs)(f)
        QUERIES[f.__name__] = discussion.QUERIES.pop(f.__name__)
        if sql is not None:
            SQL[f.__name__] = discussion.SQL.pop(f.__name__)
        return run

    return register


def validation_rows(spark: SparkSession, root: str) -> DataFrame:
    """Labelled pairs (0 or 1; others are left out), one row an id, with four flags of having been seen among the unlabelled ones."""
    p = table(spark, root, "candidate_pairs").select(
        keys.plain_id(F.col("pair_id")).alias("pair_id"), keys.plain_id(F.col("response_id")).alias("response_id"), keys.plain_key(F.col("response_author")).alias("author"), keys.plain_id(F.col("submission_id")).alias("submission_id"),
        F.trim("is_correction_relation").alias("label"), F.coalesce("public_correction_score", F.lit(0.0)).alias("score"), "pair_source",
    ).filter(F.col("pair_id").isNotNull())
    p = Scratch(spark, "validation").keep(p)
    clear = p.filter(F.col("label").isin("0", "1")).groupBy("pair_id").agg(*[F.max(c).alias(c) for c in ("response_id", "author", "submission_id", "label", "score", "pair_source")])
    known = p.filter(F.col("label").isNull())
    seen = pairs.membership(clear, known, {"pair": "pair_id", "response": "response_id", "author": "author", "thread": "submission_id"})
    return seen.withColumn("y", F.col("label").cast("int"))


_KEY = "lower(trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))"
VAL = f"""v0 AS MATERIALIZED (SELECT {_id('pair_id')} AS pair_id, {_id('response_id')} AS response_id, {_KEY.format('response_author')} AS author, {_id('submission_id')} AS submission_id, trim(is_correction_relation) AS label, coalesce(public_correction_score, 0) AS score, pair_source FROM candidate_pairs WHERE {_id('pair_id')} IS NOT NULL),
v1 AS (SELECT pair_id, max(response_id) AS response_id, max(author) AS author, max(submission_id) AS submission_id, max(label) AS label, max(score) AS score, max(pair_source) AS pair_source FROM v0 WHERE label IN ('0', '1') GROUP BY 1),
val AS MATERIALIZED (SELECT *, label::INT AS y, coalesce(pair_id IN (SELECT pair_id FROM v0 WHERE label IS NULL), false)::INT AS seen_pair, coalesce(response_id IN (SELECT response_id FROM v0 WHERE label IS NULL AND response_id IS NOT NULL), false)::INT AS seen_response,
 coalesce(author IN (SELECT author FROM v0 WHERE label IS NULL AND author IS NOT NULL), false)::INT AS seen_author, coalesce(submission_id IN (SELECT submission_id FROM v0 WHERE label IS NULL AND submission_id IS NOT NULL), false)::INT AS seen_thread FROM v1)""".replace("{", "{{").replace("}", "}}")


@query(f"WITH {VAL}\n>>SELECT pair_id, response_id, author, submission_id, label, score, pair_source, y, seen_pair, seen_response, seen_author, seen_thread FROM val", "score")
def validation_frame(spark, root):
    return validation_rows(spark, root)


@query(
    f"""WITH {VAL}
>>SELECT (SELECT count(*) FROM v0 WHERE label IS NOT NULL) AS labelled_rows, (SELECT count(*) FROM v0 WHERE label = 'unclear') AS unclear_rows, count(*) AS pairs, sum(seen_pair) AS pair_overlap, sum(seen_response) AS response_overlap, sum(seen_author) AS author_overlap, sum(seen_thread) AS thread_overlap,
 count(DISTINCT submission_id) AS threads, count(DISTINCT submission_id) FILTER (seen_thread = 1) AS threads_seen, count(DISTINCT author) AS authors, count(DISTINCT author) FILTER (seen_author = 1) AS authors_seen FROM val""",
    "", "pair_overlap response_overlap author_overlap thread_overlap",
)
def validation_diagnostics(spark, root):
    """How many labelled pairs there are, and how much of them was seen before."""
    v = Scratch(spark, "val").keep(validation_rows(spark, root))
    raw = table(spark, root, "candidate_pairs").filter(keys.plain_id(F.col("pair_id")).isNotNull())
    n = raw.agg(F.count_if(F.col("is_correction_relation").isNotNull()).alias("labelled_rows"), F.count_if(F.trim("is_correction_relation") == "unclear").alias("unclear_rows"))
    d = v.agg(
        F.count(F.lit(1)).alias("pairs"), *[F.sum(f"seen_{c}").alias(f"{c}_overlap") for c in ("pair", "response", "author", "thread")], F.count_distinct("submission_id").alias("threads"), F.count_distinct(F.when(F.col("seen_thread") == 1, F.col("submission_id"))).alias("threads_seen"),
        F.count_distinct("author").alias("authors"), F.count_distinct(F.when(F.col("seen_author") == 1, F.col("author"))).alias("authors_seen"),
    )
    return n.join(F.broadcast(d))  # one row each


MODELS = {"score": "score", "prediction": "pred", "candidate": "candidate", "institutions": "anti", "pairs": "least(pair_count / 5.0, 1.0)", "words": "least(words / 200.0, 1.0)", "score_and_pairs": "(score + least(pair_count / 5.0, 1.0)) / 2"}
_LONG = " UNION ALL ".join(f"SELECT '{n}' AS model, ({c})::DOUBLE AS score, hostile::INT AS y FROM rec" for n, c in MODELS.items())
_RANK = """g AS (SELECT {k}, score, sum(y) AS pos, count(*) AS n FROM l GROUP BY ALL), c AS (SELECT *, sum(pos) OVER (PARTITION BY {k} ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY {k} ORDER BY score DESC) AS above, sum(pos) OVER (PARTITION BY {k}) AS p, sum(n) OVER (PARTITION BY {k}) AS t FROM g),
rk AS (SELECT {k}, coalesce(sum(pos * tp / above) / nullif(max(p), 0), 0) AS average_precision, sum(pos * (t - p - above + tp + (n - pos) / 2)) / nullif(max(p) * (max(t) - max(p)), 0) AS roc_auc FROM c GROUP BY ALL)"""


@query(f"WITH {{REC}}, l AS ({_LONG}), {_RANK.replace('{k}', 'model')}, m AS (SELECT model, {_TM} FROM (SELECT *, score >= 0.5 AS s FROM l) GROUP BY 1)\n>>SELECT m.*, {_TM2}, average_precision, roc_auc FROM m JOIN rk USING (model)", "brier prevalence precision recall f1 average_precision roc_auc")
def model_comparison(spark, root):
    """Seven scores on the same comments, unrounded."""
    return metrics.compare(kept(spark, root), {n: F.expr(c) for n, c in MODELS.items()}, y="hostile")


@query(
    f"""WITH {{REC}}, l AS (SELECT score, hostile::INT AS y, unnest([0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7])::DOUBLE AS threshold FROM rec)
>>SELECT *, {_TM2} FROM (SELECT threshold, {_TM} FROM (SELECT *, score >= threshold AS s FROM l) GROUP BY threshold)""",
    "threshold brier prevalence precision recall f1",
)
def threshold_table(spark, root):
    """0.30 to 0.70 in steps of 0.05."""
    return metrics.sweep(kept(spark, root).withColumn("y", F.col("hostile").cast("int")), [round(0.3 + 0.05 * k, 2) for k in range(9)])


@query(
    """WITH l AS (SELECT comment_id, lower(trim(manual_label)) AS y FROM comment_labels WHERE manual_label IS NOT NULL), m AS (SELECT comment_id, min(y) AS p FROM l GROUP BY 1), j AS (SELECT y, p FROM l JOIN m USING (comment_id)),
x AS (SELECT y AS label, 1 AS t, 0 AS p, (y = p)::INT AS b FROM j UNION ALL SELECT p, 0, 1, 0 FROM j), g AS (SELECT label, sum(t) AS rows, sum(p) AS predicted, sum(b) AS hits FROM x GROUP BY 1)
>>SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, CASE WHEN rows > 0 THEN hits / rows ELSE 0 END AS recall, sum(hits) OVER () / sum(rows) OVER () AS accuracy FROM g""",
    "precision recall accuracy", "rows predicted hits",
)
def type_metrics(spark, root):
    """Accuracy and counts by class of a several-class prediction: every label against its comment's first one."""
    labels = table(spark, root, "comment_labels").select("comment_id", F.lower(F.trim("manual_label")).alias("y")).filter(F.col("y").isNotNull())
    first = labels.groupBy("comment_id").agg(F.min("y").alias("p"))
    return metrics.class_metrics(labels.join(first, "comment_id"), "y", "p")


def subgroup_rows(spark: SparkSession, root: str) -> DataFrame:
    """Predicted comments of authors with what their subgroups are told by."""
    r = kept(spark, root)
    h = history.pair_history(r).select("submission_id", "author", "prior_comments", "prior_cross_subreddit")
    early = in_order(r).filter(F.col("rank") <= 10).groupBy("submission_id").agg(F.avg("hostile").alias("early_hostility"))
    return Scratch(spark, "subgroups").keep(r.filter(F.col("author").isNotNull()).join(h, ["submission_id", "author"]).join(early, "submission_id").withColumn("y", F.col("hostile").cast("int")))


def _dimensions(f: DataFrame) -> dict[str, F.Column]:
    return {
        "all": F.lit("all"), "candidate": F.when(F.col("candidate") == 1, "candidate").otherwise("other"), "length": metrics.quartile_names(f, "words"), "group": F.col("grp"), "subreddit": F.col("subreddit"),
        "participation": relations.participation(F.col("prior_comments"), F.col("prior_cross_subreddit")), "opening": F.when(F.col("early_hostility") > 0, "any hostile language").otherwise("no hostile language"),
    }


_DIMS = {
    "all": "'all'", "candidate": "CASE WHEN candidate = 1 THEN 'candidate' ELSE 'other' END", "length": "CASE WHEN words <= q1 THEN 'shortest' WHEN words <= q2 THEN 'short' WHEN words <= q3 THEN 'long' ELSE 'longest' END", "group": "grp", "subreddit": "subreddit",
    "participation": "CASE WHEN prior_comments < 2 THEN 'limited prior record' WHEN prior_cross_subreddit = 1 THEN 'multiple prior subreddits' ELSE 'one prior subreddit' END", "opening": "CASE WHEN early_hostility > 0 THEN 'any hostile language' ELSE 'no hostile language' END",
}
SUBS = f"""{{HIST}}, eh AS (SELECT submission_id, avg(hostile) AS early_hostility FROM ord WHERE rank <= 10 GROUP BY 1),
f AS MATERIALIZED (SELECT r.*, h.prior_comments, h.prior_cross_subreddit, early_hostility, r.hostile::INT AS y FROM rec r JOIN history h USING (submission_id, author) JOIN eh USING (submission_id) WHERE r.author IS NOT NULL),
q AS (SELECT quantile_cont(words, 0.25) AS q1, quantile_cont(words, 0.5) AS q2, quantile_cont(words, 0.75) AS q3 FROM f),
l AS MATERIALIZED ({' UNION ALL '.join(f"SELECT score, y, '{d}' AS dimension, ({c})::VARCHAR AS subgroup FROM f, q" for d, c in _DIMS.items())})"""


@query(
    f"WITH {SUBS}, {_RANK.replace('{k}', 'dimension, subgroup')}, m AS (SELECT dimension, subgroup, {_TM} FROM (SELECT *, score >= 0.5 AS s FROM l) GROUP BY ALL)\n>>SELECT m.*, {_TM2}, average_precision, roc_auc FROM m JOIN rk USING (dimension, subgroup) WHERE n >= 30 AND tp + fn > 0 AND fp + tn > 0",
    "brier prevalence precision recall f1 average_precision roc_auc",
)
def subgroup_table(spark, root):
    """All metrics by seven dimensions, unrounded scores."""
    f = subgroup_rows(spark, root)
    return metrics.subgroups(f, _dimensions(f), 0.5)


@query()
def subgroup_intervals(spark, root):
    """Bootstrap intervals (2,000 resamples) of the metrics in four subgroups."""
    f = subgroup_rows(spark, root)
    four = f.select("y", "score", F.explode(F.array(F.lit("all"), F.when(F.col("prior_comments") >= 2, "with prior record"), F.when(F.col("early_hostility") > 0, "hostile opening"), F.when(F.col("candidate") == 1, "candidate"))).alias("subgroup")).filter(F.col("subgroup").isNotNull())
    return simulation.summarise(simulation.bootstrap(four, 2000, by=["subgroup"]), "subgroup", ["average_precision", "roc_auc", "f1"])


@query()
def calibration_summary(spark, root):
    """Brier score, expected calibration error over ten bins, recalibration intercept and slope (see the tests for the score equations)."""
    r = kept(spark, root).withColumn("y", F.col("hostile").cast("int"))
    line = metrics.recalibration(r)
    one = r.agg(F.avg(F.pow(F.col("score") - F.col("y"), 2)).alias("brier")).join(F.broadcast(metrics.calibration(r).agg(F.sum("ece_part").alias("ece"))))  # one row each
    return one.withColumns({"intercept": F.lit(line["intercept"]), "slope": F.lit(line["slope"]), "converged": F.lit(line["converged"])})


@query("WITH {REC}\n>>SELECT comment_id, submission_id, subreddit, score, (score >= 0.5)::INT AS predicted, hostile::INT AS label FROM rec", "score")
def prediction_export(spark, root):
    """Chosen columns with the score and its thresholded prediction."""
    return recs(spark, root).select("comment_id", "submission_id", "subreddit", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("hostile").cast("int").alias("label"))
