"""Queries of estimation, simulation, reply networks, classifiers and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import cohort, estimation, history, modeling, profiles, relations, simulation
from threadloom.operators.hierarchy import below, comment_hierarchy
from threadloom.plans.discussion import CTE, kept, rel_kept, rounded
from threadloom.runtime import Scratch
from threadloom.sources.tables import table
from threadloom.streaming import threads


def _frame(spark: SparkSession, root: str) -> DataFrame:
    """Predicted comments with the author's history and the thread's early context."""
    r = kept(spark, root)
    h = history.pair_history(r)
    f = r.filter(F.col("author").isNotNull()).join(h.select("submission_id", "author", "prior_comments", "prior_cross_group", "prior_rate"), ["submission_id", "author"])
    shaped = f.select("comment_id", "submission_id", "author", "grp", "pred", "score", "hostile", F.log1p("words").alias("log_words"), F.log1p("prior_comments").alias("log_prior"), "prior_cross_group")
    return Scratch(spark, "design").keep(shaped)


def _design(frame: DataFrame) -> estimation.Design:
    return estimation.Design(["prior_cross_group", "log_prior", "log_words", "hostile", "prior_cross_group:log_prior"], {"grp": estimation.levels(frame, "grp")})


def logit_two_way(spark: SparkSession, root: str) -> DataFrame:
    """Coefficients with errors clustered by thread and author."""
    f = _frame(spark, root)
    fit = estimation.fit_logit(f, _design(f), "pred", ("submission_id", "author"))
    return spark.createDataFrame([(r["term"], r["estimate"], r["se"], r["z"], r["p"], r["odds_ratio"]) for r in fit.table()], "term string, estimate double, se double, z double, p double, odds_ratio double")


def logit_one_way(spark: SparkSession, root: str) -> DataFrame:
    f = _frame(spark, root)
    fit = estimation.fit_logit(f, _design(f), "pred", ("submission_id",))
    return spark.createDataFrame([(r["term"], r["estimate"], r["se"]) for r in fit.table()], "term string, estimate double, se double")


def ols_two_way(spark: SparkSession, root: str) -> DataFrame:
    f = _frame(spark, root)
    fit = estimation.fit_ols(f, _design(f), "score", ("submission_id", "author"))
    return spark.createDataFrame([(r["term"], r["estimate"], r["se"]) for r in fit.table()], "term string, estimate double, se double")


def model_statistics(spark: SparkSession, root: str) -> DataFrame:
    f = _frame(spark, root)
    s = estimation.fit_logit(f, _design(f), "pred").statistics()
    return spark.createDataFrame([(s["n"], s["log_likelihood"], s["aic"], s["bic"], s["mcfadden"], s["converged"])], "n bigint, log_likelihood double, aic double, bic double, mcfadden double, converged boolean")


def scenario_contrasts(spark: SparkSession, root: str) -> DataFrame:
    """Average marginal predictions and differences with delta-method errors."""
    f = _frame(spark, root)
    d = _design(f)
    fit = estimation.fit_logit(f, d, "pred", ("submission_id", "author"))
    on, off = {"prior_cross_group": F.lit(1)}, {"prior_cross_group": F.lit(0)}
    rows = [("cross group", [(1.0, on)]), ("one group", [(1.0, off)]), ("difference", [(1.0, on), (-1.0, off)])]
    out = [(n, *(c[k] for k in ("estimate", "se", "low", "high"))) for n, s in rows for c in [estimation.contrast(f, d, fit, s)]]
    return spark.createDataFrame(out, "scenario string, estimate double, se double, low double, high double")


def leave_one_group_out(spark: SparkSession, root: str) -> DataFrame:
    """The cross-group coefficient without each group in turn."""
    f = _frame(spark, root)
    out = []
    for g in estimation.levels(f, "grp"):
        part = f.filter(F.col("grp") != g)
        d = estimation.Design(["prior_cross_group", "log_prior", "log_words", "hostile"])
        row = estimation.fit_logit(part, d, "pred", ("submission_id",)).table()[1]
        out.append((g, row["estimate"], row["se"]))
    return spark.createDataFrame(out, "left_out string, estimate double, se double")


#: Early window, its value, horizon in days, least prior comments, least days of history.
WINDOWS = [("comments", 5, 7, 2, 7), ("comments", 10, 1, 2, 7), ("comments", 10, 7, 0, 7), ("comments", 10, 7, 1, 7), ("comments", 10, 7, 5, 7), ("comments", 10, 7, 2, 0), ("comments", 10, 7, 2, 14), ("comments", 10, 7, 2, 7), ("comments", 10, 30, 2, 7), ("comments", 20, 7, 2, 7), ("hours", 1, 7, 2, 7), ("hours", 6, 7, 2, 7), ("hours", 24, 7, 2, 7)]


def _windows(spark: SparkSession, root: str):
    r = kept(spark, root)
    past = Scratch(spark, "history").keep(history.pair_history(r))
    for window, value, horizon, prior, days in WINDOWS:
        yield (window, float(value), horizon, prior, days), cohort.cohort(r, window, float(value), float(horizon), prior, float(days), past)


def window_sensitivity(spark: SparkSession, root: str) -> DataFrame:
    """First responses and their rate over the grid of 13 windows, horizons and eligibilities."""
    out = None
    for (window, value, horizon, prior, days), c in _windows(spark, root):
        row = c.agg(F.count(F.lit(1)).alias("responses"), F.coalesce(F.sum("response"), F.lit(0)).alias("corrections")).select(F.lit(window).alias("window"), F.lit(value).alias("value"), F.lit(horizon).alias("horizon_days"), F.lit(prior).alias("min_prior"), F.lit(days).alias("min_days"), "responses", "corrections")
        out = row if out is None else out.unionByName(row)
    return out


def window_models(spark: SparkSession, root: str, least: int = 500) -> DataFrame:
    """The cross-group coefficient over the same grid; specifications of fewer than ``least`` responses or one outcome are left out."""
    rows = []
    scratch = Scratch(spark, "windows")
    for spec, c in _windows(spark, root):
        c, seen = scratch.counted(c, n=F.lit(True), ones=F.col("response") == 1)
        if seen["n"] < least or seen["ones"] in (0, seen["n"]):
            continue
        fit = estimation.fit_logit(c.withColumn("log_prior", F.log1p("prior_comments")), estimation.Design(["prior_cross_group", "early_presence", "early_ambient_hostility", "log_prior", "early_activity"]), "response", ("submission_id", "author"))
        rows += [(*spec, fit.n, t["term"], t["estimate"], t["se"], fit.converged) for t in fit.table()]
    return spark.createDataFrame(rows, "window string, value double, horizon_days int, min_prior int, min_days int, n bigint, term string, estimate double, se double, converged boolean")


def bootstrap_ci(spark: SparkSession, root: str) -> DataFrame:
    """Mean and 95 % interval of the metrics over 2,000 resamples of unrounded scores."""
    ev = kept(spark, root).select("score", F.col("hostile").alias("y"))
    draws = simulation.bootstrap(ev, 2000).withColumn("all", F.lit("all"))
    return simulation.summarise(draws, "all", ["average_precision", "roc_auc", "f1"])


ABM_RUNS = 500


def _abm(spark: SparkSession, root: str) -> DataFrame:
    """Thread-author instances with thread climate, and a model of who corrects later: 13 scenarios of its covariates."""
    r = kept(spark, root)
    t = profiles.climate_flags(profiles.climate(r)).select("submission_id", (F.col("early_corrections") > 0).cast("int").alias("norm"), F.col("high_hostility_rate").alias("hostile_climate"), F.col("high_early_audience_cross_group_share").alias("high_audience"))
    inst = Scratch(spark, "abm").keep(profiles.instances(r).join(t, "submission_id").select("submission_id", "author", "cross_group", "high_audience", "norm", "hostile_climate", "corrected"))
    d = estimation.Design(["cross_group", "high_audience", "norm", "hostile_climate", "cross_group:norm"])
    beta = estimation.fit_logit(inst, d, "corrected", ("submission_id",)).beta.tolist()

    def p(**fixed: int) -> F.Column:
        value = lambda c: F.lit(float(fixed[c])) if c in fixed else F.col(c).cast("double")
        z = F.lit(beta[0])
        for term, b in zip(d.terms, beta[1:]):
            x = F.lit(b)
            for part in term.split(":"):
                x = x * value(part)
            z = z + x
        return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0))))

    both = [{c: v} for c in ("cross_group", "high_audience", "norm", "hostile_climate") for v in (0, 1)] + [{"norm": n, "hostile_climate": h} for n in (0, 1) for h in (0, 1)]
    scenarios = {"observed": p()} | {"_".join(f"{c}_{v}" for c, v in f.items()): p(**f) for f in both}
    return simulation.bernoulli_runs(inst, scenarios, ABM_RUNS)


def abm_draws(spark: SparkSession, root: str) -> DataFrame:
    """Outcomes of 13 scenarios over 500 runs with shared random numbers."""
    return _abm(spark, root)


def abm_summary(spark: SparkSession, root: str) -> DataFrame:
    """Per scenario mean, deviation and 95 % interval over the runs."""
    return simulation.summarise(_abm(spark, root), "scenario", ["correcting", "rate", "active_threads", "activation", "cross_group_share", "high_audience_share", "top_share"])


NETWORK_DRAWS = 1000


def _network(spark: SparkSession, root: str) -> DataFrame:
    """First later responses with their openings; five scenarios of wider access, one more correction, broader relations, both."""
    scratch = Scratch(spark, "focal")
    r = rel_kept(spark, root)
    split = scratch.keep(cohort.context_split(r))
    f = relations.analysis_frame(cohort.cohort(r, min_prior=0, min_days=0.0), relations.early_relations(split)).join(split.filter("side = 'later'").select("comment_id", "created_utc"), "comment_id")
    f = scratch.keep(f.withColumnRenamed("response", "outcome"))
    d = estimation.Design(["prior_cross_group", "early_presence", "early_additional", "early_relation_diversity_z", "early_ambient_hostility", "log_prior", "early_activity"])
    fit = estimation.fit_logit(f, d, "outcome", ("submission_id", "author"))
    top = f.agg(F.avg("prior_cross_group").alias("share"), F.max("early_relation_diversity_z").alias("top")).first()
    share = top["share"] or 0.0
    widen = (min(2 * share, 1.0) - share) / max(1 - share, 1e-12)
    count = F.least(F.col("early_presence") + F.col("early_additional") + 1, F.lit(10))
    more = {"early_presence": (count > 0).cast("int"), "early_additional": F.greatest(count - 1, F.lit(0))}
    broad = {"early_relation_diversity_z": F.least(F.col("early_relation_diversity_z") + 1.0, F.lit(top["top"]))}
    access = {"prior_cross_group": F.lit(1)}
    designs = {"baseline": (d, {}), "access": (d, access), "more": (d, more), "broad": (d, broad), "both": (d, more | broad), "both_access": (d, more | broad | access)}
    w = F.when(F.col("prior_cross_group") == 0, F.lit(widen)).otherwise(0.0)
    mixtures = {"baseline": ("baseline", "baseline", F.lit(0.0)), "wider_access": ("baseline", "access", w), "one_more_correction": ("more", "more", F.lit(0.0)), "broader_relations": ("broad", "broad", F.lit(0.0)), "combined": ("both", "both_access", w)}
    comments = scratch.keep(split.select("comment_id", "submission_id", "created_utc"))
    reach = below(comment_hierarchy(table(spark, root, "comments")), f.select(F.col("comment_id").alias("ancestor_id")))
    return simulation.network_draws(f, comments, reach, designs, mixtures, "baseline", fit.beta, fit.covariance, NETWORK_DRAWS)


def network_simulation(spark: SparkSession, root: str) -> DataFrame:
    """Four network metrics per draw of coefficients and scenario."""
    return _network(spark, root)


def network_summary(spark: SparkSession, root: str) -> DataFrame:
    """The metrics' means and intervals, and their differences from the baseline draw by draw."""
    return simulation.against_baseline(_network(spark, root), list(simulation.NETWORK))


def network_metrics_observed(spark: SparkSession, root: str) -> DataFrame:
    r = kept(spark, root)
    reach = below(comment_hierarchy(table(spark, root, "comments")), r.filter(F.col("pred") == 1).select(F.col("comment_id").alias("ancestor_id"))).select("ancestor_id", "descendant_id")
    return rounded(simulation.network_metrics(r, reach))


def ancestor_closure(spark: SparkSession, root: str) -> DataFrame:
    """Every comment below a corrective one: (correction, comment)."""
    hits = kept(spark, root).filter(F.col("pred") == 1).select(F.col("comment_id").alias("ancestor_id"))
    return below(comment_hierarchy(table(spark, root, "comments")), hits).select(F.col("ancestor_id").alias("correction_id"), F.col("descendant_id").alias("comment_id"))


def pair_classifier(spark: SparkSession, root: str) -> DataFrame:
    """Scores of a hashed linear model for the cue flag of all candidate pairs; trained on half of the responses, whose own scores are thus in-sample."""
    p = table(spark, root, "candidate_pairs").select("annotation_id", "response_id", modeling.feature_text("pair").alias("text"), F.coalesce("response_has_correction_cue", F.lit(0)).cast("double").alias("label"))
    half = F.pmod(F.xxhash64("response_id"), F.lit(2)) == 0
    model = modeling.trainer().fit(p.filter(half))
    return modeling.score(model, p).select("annotation_id", "label", "score", "pred")


def event_windows(spark: SparkSession, root: str) -> DataFrame:
    return rounded(threads.windows(table(spark, root, "events"), "1 day"))


def event_sessions(spark: SparkSession, root: str) -> DataFrame:
    return threads.sessions(table(spark, root, "events"), "30 minutes")


QUERIES = {
    f.__name__: f
    for f in (logit_two_way, logit_one_way, ols_two_way, model_statistics, scenario_contrasts, leave_one_group_out, window_sensitivity, window_models, bootstrap_ci, abm_draws, abm_summary, network_simulation, network_summary, network_metrics_observed, ancestor_closure, pair_classifier, event_windows, event_sessions)
}

_TREE = """node AS (SELECT comment_id AS id, submission_id, parent_id AS p, t3 FROM (SELECT {k} AS comment_id, max({s}) AS submission_id, max({p}) AS parent_id, bool_or(coalesce(lower(trim(parent_id)) LIKE 't3\\_%' ESCAPE '\\', false) OR coalesce({p} = {s}, false)) AS t3 FROM comments GROUP BY 1) WHERE comment_id IS NOT NULL),
up AS (SELECT n.id, n.p FROM node n JOIN node m ON m.id = n.p WHERE NOT n.t3 AND n.p IS NOT NULL),
reach(anc, des, n) AS (SELECT p, id, 1 FROM up UNION SELECT up.p, reach.des, n + 1 FROM reach JOIN up ON up.id = reach.anc WHERE n < 400),
ends AS (SELECT DISTINCT des FROM reach JOIN node ON node.id = anc WHERE node.t3),
closure AS (SELECT anc, des FROM reach WHERE des IN (SELECT des FROM ends))"""
_ID = "nullif(regexp_replace(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '^t[13]_', ''), '')"
TREE = _TREE.format(k=_ID.format("comment_id"), s=_ID.format("submission_id"), p=_ID.format("parent_id"))
_REC = CTE["REC"].replace("WITH", "", 1).replace(" anti", ' "anti"')
SQL = {
    "event_windows": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 6) + 0.0 AS value FROM events GROUP BY 1, 2",
    "event_sessions": """WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INT AS new FROM events), s AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM s GROUP BY user_id, k""",
    "ancestor_closure": f"WITH RECURSIVE {_REC}, {TREE} SELECT anc AS correction_id, des AS comment_id FROM closure WHERE anc IN (SELECT comment_id FROM rec WHERE pred = 1)",
    "network_metrics_observed": f"""WITH RECURSIVE {_REC}, {TREE}, f AS (SELECT submission_id, min(created_utc) AS t FROM rec WHERE pred = 1 GROUP BY 1)
SELECT round((SELECT avg(pred) FROM rec), 6) + 0.0 AS response_rate, (SELECT count(DISTINCT submission_id) FROM rec WHERE pred = 1) AS threads_with_correction, (SELECT count(*) FROM rec JOIN f USING (submission_id) WHERE created_utc > t) AS comments_after,
 (SELECT count(DISTINCT des) FROM closure WHERE anc IN (SELECT comment_id FROM rec WHERE pred = 1) AND des IN (SELECT comment_id FROM rec)) AS comments_below""",
}


def _window_sql(k: int, window: str, value: float, horizon: int, prior: int, days: int) -> str:
    """One window of the grid over ``vord`` and ``history``."""
    cut = f"max(created_utc) FILTER (rank = {int(value)})" if window == "comments" else f"min(thread_start) + {value} * 3600.0"
    early = f"rank <= {int(value)}" if window == "comments" else "created_utc <= cutoff"
    return f"""i{k} AS (SELECT * FROM vord WHERE created_utc <= thread_start + {horizon} * 86400.0), c{k} AS (SELECT submission_id, {cut} AS cutoff FROM i{k} GROUP BY 1),
s{k} AS MATERIALIZED (SELECT * FROM (SELECT i{k}.*, CASE WHEN {early} THEN 'early' WHEN created_utc > cutoff THEN 'later' END AS side FROM i{k} JOIN c{k} USING (submission_id) WHERE cutoff IS NOT NULL) WHERE side IS NOT NULL),
e{k} AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY submission_id, author ORDER BY created_utc, comment_id) AS k FROM s{k} s WHERE side = 'later' AND submission_id IN (SELECT submission_id FROM s{k} WHERE side = 'early') AND (submission_id, author) NOT IN (SELECT submission_id, author FROM s{k} WHERE side = 'early')) WHERE k = 1),
w{k} AS (SELECT '{window}' AS window, {float(value)}::DOUBLE AS value, {horizon} AS horizon_days, {prior} AS min_prior, {days} AS min_days, count(*) AS responses, coalesce(sum(e.pred), 0)::BIGINT AS corrections FROM e{k} e JOIN history h USING (submission_id, author) WHERE prior_comments >= {prior} AND history_days >= {days})"""


_GRID = ",\n".join(_window_sql(k, *w) for k, w in enumerate(WINDOWS))
_HIST = CTE["HIST"].replace(" anti", ' "anti"')
SQL["window_sensitivity"] = f"""{_HIST}, vord AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY created_utc, comment_id) AS rank FROM vrec),
{_GRID}
{' UNION ALL '.join(f'SELECT * FROM w{k}' for k in range(len(WINDOWS)))}"""
if not _HIST.lstrip().startswith("WITH"):
    SQL["window_sensitivity"] = "WITH " + SQL["window_sensitivity"]
