"""Queries over threads, authors, histories, cohorts, pairs, samples and metrics, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import keys, lexicon, text
from threadloom.operators import cohort, history, metrics, pairs, profiles, relations, sampling, sets
from threadloom.operators.records import comment_records, in_order, records
from threadloom.runtime import Scratch
from threadloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

GROUPS = ["other", "public_health_or_news", "skeptical_or_anti_institutional", "vaccine_experience_or_health"]


def recs(spark: SparkSession, root: str) -> DataFrame:
    return records(table(spark, root, "comments"), table(spark, root, "comment_predictions"))


def kept(spark: SparkSession, root: str) -> DataFrame:
    """The records without texts, written once: for operators that read them several times."""
    return Scratch(spark, "records").keep(recs(spark, root).drop("body", "title"))


def claims_marked(spark: SparkSession, root: str) -> DataFrame:
    """As ``kept``, with a flag of comments that are claims."""
    return Scratch(spark, "claims").keep(recs(spark, root).withColumn("claim", _is_claim()).drop("body", "title"))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places (the order of summation differs between engines)."""
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, doubles: str = "", longs: str = ""):
    """Register a function as a query; its SQL gets the same rounding."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        run = lambda spark, root: rounded(f(spark, root))
        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            fix = [f"round({c}::DOUBLE, 6) + 0.0 AS {c}" for c in doubles.split()] + [f"{c}::BIGINT AS {c}" for c in longs.split()]
            body = sql.format(**CTE) if "{" in sql else sql
            body = re.sub(r"\banti\b", '"anti"', body)  # a reserved word there
            head, _, tail = body.rpartition("\n>>")
            fix = [re.sub(r"\banti\b", '"anti"', x) for x in fix]
            SQL[f.__name__] = f"{head}\nSELECT * {'REPLACE (' + ', '.join(fix) + ')' if fix else ''} FROM ({tail})"
        return run

    return register


def _key(c: str) -> str:
    return f"lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))"


def _id(c: str) -> str:
    return f"nullif(regexp_replace({_key(c)}, '^t[13]_', ''), '')"


SPACES = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _compact(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{SPACES}', ' ', 'g'))"


def _terms(c: str, terms: list[str]) -> str:
    return f"coalesce(regexp_matches(lower({c}), '{lexicon.pattern(terms)}')::BIGINT, 0)"


_AUTHOR = "CASE WHEN lower(trim(coalesce(author, ''))) NOT IN ('', '[deleted]', 'deleted', 'automoderator') THEN lower(trim(coalesce(author, ''))) END"
CM = f"""cm AS (
  SELECT {_id('comment_id')} AS comment_id, max({_id('submission_id')}) AS submission_id, max({_id('parent_id')}) AS parent_id, max({_AUTHOR}) AS author,
         max(coalesce({_key('subreddit')}, 'unknown')) AS subreddit, max(created_utc) AS created_utc, max(body) AS body, max(submission_title) AS title, max(candidate_correction::INT) AS candidate
  FROM comments WHERE {_id('comment_id')} IS NOT NULL GROUP BY 1)"""
REC = f"""{CM},
pr AS (
  SELECT {_id('comment_id')} AS comment_id, max(coalesce({_key('community_group_proxy')}, 'unknown')) AS grp, max(coalesce(public_correction_score, 0)) AS score, max(coalesce(public_correction_pred, 0)) AS pred,
         max(coalesce(pair_relation_candidate_count, 0)) AS pair_count
  FROM comment_predictions GROUP BY 1),
rec AS MATERIALIZED (
  SELECT comment_id, submission_id, parent_id, author, subreddit, grp, created_utc, body, title, coalesce(candidate, 0) AS candidate, score, pred, pair_count,
         CASE WHEN {_compact('body')} = '' THEN 0 ELSE len(string_split({_compact('body')}, ' ')) END AS words,
         {_terms('body', lexicon.HOSTILITY)} AS hostile, {_terms('body', lexicon.ANTI_INSTITUTIONAL)} AS anti
  FROM cm JOIN pr USING (comment_id) WHERE submission_id IS NOT NULL AND created_utc IS NOT NULL),
ord AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY created_utc, comment_id) AS rank, min(created_utc) OVER (PARTITION BY submission_id) AS thread_start FROM rec)"""
USERS = REC + """,
ent AS (SELECT author, -sum(p * ln(p)) AS e FROM (SELECT author, n / sum(n) OVER (PARTITION BY author) AS p FROM (SELECT author, subreddit, count(*) AS n FROM rec WHERE author IS NOT NULL GROUP BY ALL)) GROUP BY 1),
entg AS (SELECT author, -sum(p * ln(p)) AS e FROM (SELECT author, n / sum(n) OVER (PARTITION BY author) AS p FROM (SELECT author, grp, count(*) AS n FROM rec WHERE author IS NOT NULL GROUP BY ALL)) GROUP BY 1),
dom AS (SELECT author, subreddit AS v FROM (SELECT author, subreddit, row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, min(struct_pack(a := created_utc, b := comment_id))) AS k FROM rec WHERE author IS NOT NULL GROUP BY author, subreddit) WHERE k = 1),
domg AS (SELECT author, grp AS v FROM (SELECT author, grp, row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, min(struct_pack(a := created_utc, b := comment_id))) AS k FROM rec WHERE author IS NOT NULL GROUP BY author, grp) WHERE k = 1),
users AS MATERIALIZED (
  SELECT author, count(*) AS comments, sum(pred) AS corrections, count(DISTINCT subreddit) AS subreddits, count(DISTINCT grp) AS groups, count(DISTINCT submission_id) AS threads,
         any_value(ent.e) AS subreddit_entropy, any_value(entg.e) AS group_entropy, any_value(dom.v) AS dominant_subreddit, any_value(domg.v) AS dominant_group,
         (count(DISTINCT subreddit) > 1)::INT AS cross_subreddit, (count(DISTINCT grp) > 1)::INT AS cross_group, sum(pred) / count(*) AS correction_rate
  FROM rec JOIN ent USING (author) JOIN entg USING (author) JOIN dom USING (author) JOIN domg USING (author) WHERE author IS NOT NULL GROUP BY author)"""
THREADS = REC + """,
thr AS MATERIALIZED (
  SELECT submission_id, arg_min(subreddit, rank) AS subreddit, arg_min(grp, rank) AS grp, count(*) AS comments, count(DISTINCT author) AS authors, sum(candidate) AS candidates, sum(pred) AS corrections,
    count(DISTINCT author) FILTER (pred = 1) AS correctors, max(score) AS max_score, count(*) FILTER (rank > 10) AS later_comments, coalesce(sum(pred) FILTER (rank > 10), 0) AS later_corrections,
    count(DISTINCT author) FILTER (rank > 10 AND pred = 1) AS later_correctors, sum(hostile) AS hostile, sum(anti) AS anti, count(*) FILTER (rank <= 10) AS early_comments,
    sum(pred) FILTER (rank <= 10) AS early_corrections, sum(hostile) FILTER (rank <= 10) AS early_hostile, sum(anti) FILTER (rank <= 10) AS early_anti, coalesce(min(rank) FILTER (pred = 1), 0) AS first_correction_rank
  FROM ord GROUP BY submission_id),
thread AS MATERIALIZED (
  SELECT *, corrections / comments AS correction_rate, CASE WHEN authors > 0 THEN correctors / authors ELSE 0 END AS author_rate, CASE WHEN later_comments > 0 THEN later_corrections / later_comments ELSE 0 END AS later_correction_rate,
    greatest(authors - correctors, 0) AS exposed, (authors >= 20 AND corrections = 0)::INT AS high_without_correction, hostile / comments AS hostility_rate, anti / comments AS anti_rate,
    early_hostile / early_comments AS early_hostility_rate, early_anti / early_comments AS early_anti_rate FROM thr)"""
HIST = REC + """,
vrec AS MATERIALIZED (SELECT *, min(created_utc) OVER (PARTITION BY submission_id) AS thread_start FROM rec WHERE author IS NOT NULL),
probe AS (SELECT submission_id, author, min(thread_start) AS thread_start FROM vrec GROUP BY ALL),
hist AS MATERIALIZED (
  SELECT p.submission_id, p.author, p.thread_start, count(v.comment_id) AS prior_comments, count(DISTINCT v.subreddit) AS prior_subreddits, count(DISTINCT v.grp) AS prior_groups, coalesce(sum(v.pred), 0) AS prior_corrections
  FROM probe p LEFT JOIN vrec v ON v.author = p.author AND v.created_utc < p.thread_start GROUP BY ALL),
history AS MATERIALIZED (
  SELECT *, CASE WHEN prior_comments > 0 THEN prior_corrections / prior_comments ELSE 0 END AS prior_rate, (prior_subreddits > 1)::INT AS prior_cross_subreddit, (prior_groups > 1)::INT AS prior_cross_group,
    (prior_comments > 0)::INT AS prior_observed, (prior_comments >= 2)::INT AS prior_eligible, greatest((thread_start - (SELECT min(created_utc) FROM vrec)) / 86400.0, 0) AS history_days FROM hist)"""
SPLIT = HIST + """,
vord AS (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY created_utc, comment_id) AS rank FROM vrec),
inside AS (SELECT * FROM vord WHERE created_utc <= thread_start + 7 * 86400.0),
cut AS (SELECT submission_id, max(created_utc) FILTER (rank = 10) AS cutoff FROM inside GROUP BY 1),
sided AS (SELECT inside.*, cutoff, CASE WHEN rank <= 10 THEN 'early' WHEN created_utc > cutoff THEN 'later' END AS side FROM inside JOIN cut USING (submission_id) WHERE cutoff IS NOT NULL),
split AS MATERIALIZED (SELECT * FROM sided WHERE side IS NOT NULL AND submission_id IN (SELECT submission_id FROM sided WHERE side = 'later')),
ent AS MATERIALIZED (
  SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY submission_id, author ORDER BY created_utc, comment_id) AS k FROM split s
    WHERE side = 'later' AND NOT EXISTS (SELECT 1 FROM split e WHERE e.side = 'early' AND e.submission_id = s.submission_id AND e.author = s.author)) WHERE k = 1),
early AS (SELECT e.*, (EXISTS (SELECT 1 FROM split p WHERE p.side = 'early' AND p.submission_id = e.submission_id AND p.comment_id = e.parent_id AND p.pred = 1))::INT AS reply FROM split e WHERE side = 'early'),
who AS (SELECT submission_id, count(*) AS early_authors, avg(coalesce(prior_cross_group, 0)) AS early_cross_share, avg(coalesce(prior_eligible, 0)) AS early_history_coverage
  FROM (SELECT DISTINCT submission_id, author FROM early) LEFT JOIN history USING (submission_id, author) GROUP BY 1),
feat AS MATERIALIZED (
  SELECT submission_id, count(*) AS early_comments, (max(pred) > 0)::INT AS early_presence, avg(pred) AS early_rate, avg(hostile * (1 - reply)) AS early_ambient_hostility, max(reply) AS early_reply_presence,
    max(hostile * reply) AS early_directed_presence, avg(hostile * reply) AS early_directed_rate, avg((pair_count > 0)::INT) AS early_candidate_share, greatest((max(cutoff) - max(thread_start)) / 3600.0, 0) AS early_hours,
    any_value(early_authors) AS early_authors, any_value(early_cross_share) AS early_cross_share, any_value(early_history_coverage) AS early_history_coverage,
    ln(1 + greatest((max(cutoff) - max(thread_start)) / 3600.0, 0)) AS early_activity FROM early JOIN who USING (submission_id) GROUP BY 1)"""
CTE = {"CM": CM, "REC": REC, "USERS": USERS, "THREADS": THREADS, "HIST": HIST, "SPLIT": SPLIT, "SP": SPACES.replace("{", "{{").replace("}", "}}")}

U_D, U_L = "subreddit_entropy group_entropy correction_rate", "corrections"
T_D = "max_score correction_rate author_rate later_correction_rate hostility_rate anti_rate early_hostility_rate early_anti_rate"
T_L = "candidates corrections later_corrections hostile anti early_corrections early_hostile early_anti"
F_D = "early_rate early_ambient_hostility early_directed_rate early_candidate_share early_hours early_cross_share early_history_coverage early_activity"


@query("WITH {CM}\n>>SELECT comment_id, submission_id, parent_id, author, subreddit, created_utc, candidate FROM cm", "created_utc")
def standard_comments(spark, root):
    """Comments in one notation, one row an id."""
    return comment_records(table(spark, root, "comments")).drop("body", "title")


@query("WITH {USERS}\n>>SELECT * FROM users", U_D, U_L)
def user_profile(spark, root):
    return profiles.user_profiles(kept(spark, root))


@query("WITH {THREADS}\n>>SELECT * FROM thread", T_D, T_L)
def thread_profile(spark, root):
    return profiles.thread_profiles(kept(spark, root))


@query(
    """>>SELECT submission_id, count(*) AS comments, count(DISTINCT nullif(trim(author), '')) AS authors, count(*) FILTER (coalesce(candidate_correction, false) AND nullif(trim(author), '') IS NOT NULL) AS candidates,
 count(DISTINCT nullif(trim(author), '')) FILTER (coalesce(candidate_correction, false)) AS correctors,
 greatest(count(DISTINCT nullif(trim(author), '')) - count(DISTINCT nullif(trim(author), '')) FILTER (coalesce(candidate_correction, false)), 0) AS exposed,
 count(*) FILTER (coalesce(candidate_correction, false) AND nullif(trim(author), '') IS NOT NULL) / count(*) AS candidate_rate FROM comments WHERE trim(coalesce(submission_id, '')) <> '' GROUP BY submission_id""".replace(">>", "\n>>"),
    "candidate_rate",
)
def raw_thread_profile(spark, root):
    return profiles.raw_thread_profiles(table(spark, root, "comments"))


@query(
    """WITH {REC}, c AS (SELECT comment_id AS parent_id, submission_id AS t FROM rec WHERE pred = 1)
>>SELECT submission_id, count(*) AS replies, sum(hostile) AS hostile_replies, count(DISTINCT parent_id) FILTER (hostile = 1 AND t = submission_id) AS corrections_hit, sum(hostile) / count(*) AS hostile_reply_rate FROM rec JOIN c USING (parent_id) GROUP BY 1""",
    "hostile_reply_rate", "hostile_replies",
)
def reply_to_correction(spark, root):
    return profiles.reply_profiles(kept(spark, root))


@query(
    """WITH {REC}, cue AS (SELECT submission_id, rank, CASE WHEN pred = 1 THEN 'correction' WHEN anti = 1 THEN 'anti_institutional' WHEN hostile = 1 THEN 'hostility' ELSE 'other' END AS cue FROM ord),
a AS (SELECT submission_id, -sum(p * ln(p)) AS e FROM (SELECT submission_id, n / sum(n) OVER (PARTITION BY submission_id) AS p FROM (SELECT submission_id, cue, count(*) AS n FROM cue GROUP BY ALL)) GROUP BY 1),
b AS (SELECT submission_id, -sum(p * ln(p)) AS e FROM (SELECT submission_id, n / sum(n) OVER (PARTITION BY submission_id) AS p FROM (SELECT submission_id, cue, count(*) AS n FROM cue WHERE rank <= 10 GROUP BY ALL)) GROUP BY 1)
>>SELECT submission_id, a.e AS cue_entropy, b.e AS early_cue_entropy FROM a JOIN b USING (submission_id)""",
    "cue_entropy early_cue_entropy",
)
def cue_entropy(spark, root):
    return profiles.cue_entropies(kept(spark, root))


def _audience_sql(where: str, p: str) -> str:
    return f"""WITH {{USERS}}, a AS (SELECT DISTINCT submission_id, author FROM ord WHERE author IS NOT NULL{where}), u AS (SELECT a.submission_id, users.* FROM a JOIN users USING (author)),
dg AS (SELECT submission_id, -sum(p * ln(p)) AS e FROM (SELECT submission_id, n / sum(n) OVER (PARTITION BY submission_id) AS p FROM (SELECT submission_id, dominant_group, count(*) AS n FROM u GROUP BY ALL)) GROUP BY 1),
ds AS (SELECT submission_id, -sum(p * ln(p)) AS e FROM (SELECT submission_id, n / sum(n) OVER (PARTITION BY submission_id) AS p FROM (SELECT submission_id, dominant_subreddit, count(*) AS n FROM u GROUP BY ALL)) GROUP BY 1)
>>SELECT submission_id, count(*) AS {p}_authors, avg(cross_group) AS {p}_cross_group_share, avg(cross_subreddit) AS {p}_cross_subreddit_share, avg(group_entropy) AS {p}_mean_group_entropy, avg(subreddit_entropy) AS {p}_mean_subreddit_entropy,
 any_value(dg.e) AS {p}_dominant_group_entropy, any_value(ds.e) AS {p}_dominant_subreddit_entropy FROM u JOIN dg USING (submission_id) JOIN ds USING (submission_id) GROUP BY 1"""


_A_D = "{0}_cross_group_share {0}_cross_subreddit_share {0}_mean_group_entropy {0}_mean_subreddit_entropy {0}_dominant_group_entropy {0}_dominant_subreddit_entropy"


@query(_audience_sql("", "audience"), _A_D.format("audience"))
def audience_metrics(spark, root):
    r = kept(spark, root)
    return profiles.audience(r, profiles.user_profiles(r), "audience")


@query(_audience_sql(" AND rank <= 10", "early_audience"), _A_D.format("early_audience"))
def early_audience_metrics(spark, root):
    r = kept(spark, root)
    return profiles.audience(in_order(r).filter(F.col("rank") <= 10), profiles.user_profiles(r), "early_audience")


def _audience_cte(n: str, where: str, p: str) -> str:
    """The audience of a thread as CTEs ``{n}``."""
    ent = lambda c: f"(SELECT submission_id, -sum(p * ln(p)) AS e FROM (SELECT submission_id, n / sum(n) OVER (PARTITION BY submission_id) AS p FROM (SELECT submission_id, {c}, count(*) AS n FROM {n}u GROUP BY ALL)) GROUP BY 1)"
    return f"""{n}u AS MATERIALIZED (SELECT a.submission_id, users.* FROM (SELECT DISTINCT submission_id, author FROM ord WHERE author IS NOT NULL{where}) a JOIN users USING (author)),
{n} AS MATERIALIZED (SELECT submission_id, count(*) AS {p}_authors, avg(cross_group) AS {p}_cross_group_share, avg(cross_subreddit) AS {p}_cross_subreddit_share, avg(group_entropy) AS {p}_mean_group_entropy, avg(subreddit_entropy) AS {p}_mean_subreddit_entropy,
 any_value(dg.e) AS {p}_dominant_group_entropy, any_value(ds.e) AS {p}_dominant_subreddit_entropy FROM {n}u JOIN {ent('dominant_group')} dg USING (submission_id) JOIN {ent('dominant_subreddit')} ds USING (submission_id) GROUP BY 1)"""


_FULL = {"cue": "cue_entropy early_cue_entropy", "rep": "replies hostile_replies corrections_hit hostile_reply_rate", **{n: f"{p}_authors " + _A_D.format(p) for n, p in (("au", "audience"), ("ea", "early_audience"))}}
_CLIMATE = f"""WITH {{USERS}}{THREADS[len(REC):]},
cu AS (SELECT submission_id, rank, CASE WHEN pred = 1 THEN 'correction' WHEN anti = 1 THEN 'anti_institutional' WHEN hostile = 1 THEN 'hostility' ELSE 'other' END AS cue FROM ord),
c1 AS (SELECT submission_id, -sum(p * ln(p)) AS e FROM (SELECT submission_id, n / sum(n) OVER (PARTITION BY submission_id) AS p FROM (SELECT submission_id, cue, count(*) AS n FROM cu GROUP BY ALL)) GROUP BY 1),
c2 AS (SELECT submission_id, -sum(p * ln(p)) AS e FROM (SELECT submission_id, n / sum(n) OVER (PARTITION BY submission_id) AS p FROM (SELECT submission_id, cue, count(*) AS n FROM cu WHERE rank <= 10 GROUP BY ALL)) GROUP BY 1),
cue AS (SELECT submission_id, c1.e AS cue_entropy, c2.e AS early_cue_entropy FROM c1 JOIN c2 USING (submission_id)),
rc AS (SELECT comment_id AS parent_id, submission_id AS t FROM rec WHERE pred = 1),
rep AS (SELECT submission_id, count(*) AS replies, sum(hostile)::BIGINT AS hostile_replies, count(DISTINCT parent_id) FILTER (hostile = 1 AND t = submission_id) AS corrections_hit, sum(hostile) / count(*) AS hostile_reply_rate FROM rec JOIN rc USING (parent_id) GROUP BY 1),
{_audience_cte('au', '', 'audience')}, {_audience_cte('ea', ' AND rank <= 10', 'early_audience')},
full_ AS MATERIALIZED (SELECT thread.*, {', '.join(f'coalesce({n}.{c}, 0) AS {c}' for n, cs in _FULL.items() for c in cs.split())} FROM thread LEFT JOIN cue USING (submission_id) LEFT JOIN rep USING (submission_id) LEFT JOIN au USING (submission_id) LEFT JOIN ea USING (submission_id)),
cuts AS (SELECT {', '.join(f'quantile_disc({c}, 0.75) AS q_{c}' for c in profiles.FLAGGED)} FROM full_ WHERE comments >= 5)
>>SELECT full_.*, {', '.join(f'(comments >= 5 AND {c} >= q_{c} AND {c} > 0)::INT AS high_{c}' for c in profiles.FLAGGED)} FROM full_, cuts"""


@query(_CLIMATE, T_D + " cue_entropy early_cue_entropy hostile_reply_rate " + _A_D.format("audience") + " " + _A_D.format("early_audience"), T_L)
def thread_climate(spark, root):
    """The full climate profile with its flags."""
    return profiles.climate_flags(profiles.climate(kept(spark, root)))


@query(
    """WITH {THREADS}, q AS (SELECT quantile_disc(hostility_rate, 0.75) AS h, quantile_disc(anti_rate, 0.75) AS a, quantile_disc(early_hostility_rate, 0.75) AS eh FROM thread WHERE comments >= 5)
>>SELECT submission_id, comments, (comments >= 5 AND hostility_rate >= h AND hostility_rate > 0)::INT AS high_hostility_rate, (comments >= 5 AND anti_rate >= a AND anti_rate > 0)::INT AS high_anti_rate,
 (comments >= 5 AND early_hostility_rate >= eh AND early_hostility_rate > 0)::INT AS high_early_hostility_rate FROM thread, q""",
)
def climate_flags(spark, root):
    return thread_climate(spark, root).select("submission_id", "comments", "high_hostility_rate", "high_anti_rate", "high_early_hostility_rate")


def _rollup_sql(key: str) -> str:
    return f"""WITH {{THREADS}}
>>SELECT coalesce({key}, 'unknown') AS {key}, count(*) AS threads, sum(comments) AS comments, sum(authors) AS author_instances, sum(corrections) AS corrections, sum(correctors) AS corrector_instances, count(*) FILTER (corrections > 0) AS threads_with_correction,
 sum(hostile) AS hostile, avg(hostility_rate) AS hostility_rate_mean, sum(corrections) / sum(comments) AS correction_rate, CASE WHEN sum(authors) > 0 THEN sum(correctors) / sum(authors) ELSE 0 END AS author_rate, count(*) FILTER (corrections > 0) / count(*) AS thread_share
FROM thread GROUP BY 1"""


_R_D, _R_L = "hostility_rate_mean correction_rate author_rate thread_share", "comments author_instances corrections corrector_instances hostile"


@query(_rollup_sql("grp"), _R_D, _R_L)
def group_rollup(spark, root):
    return profiles.roll_up(profiles.thread_profiles(kept(spark, root)), "grp")


@query(_rollup_sql("subreddit"), _R_D, _R_L)
def subreddit_rollup(spark, root):
    return profiles.roll_up(profiles.thread_profiles(kept(spark, root)), "subreddit")


INST = """{USERS}, inst AS MATERIALIZED (
 SELECT submission_id, o.author, arg_min(grp, rank) AS grp, arg_min(subreddit, rank) AS subreddit, count(*) AS comments, sum(pred) AS corrections, count(*) FILTER (rank > 10) AS later_comments, coalesce(sum(pred) FILTER (rank > 10), 0) AS later_corrections
 FROM ord o WHERE author IS NOT NULL GROUP BY 1, 2),
inst2 AS (SELECT inst.*, (corrections > 0)::INT AS corrected, (later_corrections > 0)::INT AS later_corrected, cross_group, cross_subreddit FROM inst JOIN (SELECT author, cross_group, cross_subreddit FROM users) USING (author))"""


@query(f"WITH {INST}\n>>SELECT * FROM inst2", "", "corrections later_corrections")
def thread_author_instances(spark, root):
    return profiles.instances(kept(spark, root))


@query(
    f"""WITH {INST}\n>>SELECT cross_group, grp, subreddit, count(*) AS instances, sum(corrected) AS positives, sum(comments) AS comments, sum(corrections) AS corrections, sum(corrected) / count(*) AS rate, sum(corrections) / sum(comments) AS intensity
 FROM inst2 GROUP BY GROUPING SETS ((), (grp), (subreddit), (cross_group), (cross_group, grp))""",
    "rate intensity", "positives comments corrections",
)
def instance_grouping_sets(spark, root):
    return profiles.instance_sets(profiles.instances(kept(spark, root)), [[], ["grp"], ["subreddit"], ["cross_group"], ["cross_group", "grp"]]).drop("set_id")


@query(
    f"""WITH {INST}, l AS (SELECT corrected, grp, flag, val AS v FROM inst2 UNPIVOT (val FOR flag IN (cross_group, cross_subreddit))),
c AS (SELECT *, 'all' AS context FROM l UNION ALL SELECT *, 'group:' || grp FROM l)
>>SELECT flag, context, n_with, positives_with, n_without, positives_without, rate_with, rate_without, rate_with - rate_without AS difference FROM (
 SELECT flag, context, count(*) FILTER (v = 1) AS n_with, coalesce(sum(corrected) FILTER (v = 1), 0) AS positives_with, count(*) FILTER (v = 0) AS n_without, coalesce(sum(corrected) FILTER (v = 0), 0) AS positives_without,
  coalesce(avg(corrected) FILTER (v = 1), 0) AS rate_with, coalesce(avg(corrected) FILTER (v = 0), 0) AS rate_without FROM c GROUP BY 1, 2)""",
    "rate_with rate_without difference", "positives_with positives_without",
)
def cross_group_contrast(spark, root):
    return profiles.cross_contrasts(profiles.instances(kept(spark, root)))


@query(
    """WITH {REC}
>>SELECT submission_id, author, sum(score) AS score_sum, max(score) AS score_max, 1 - product(1 - score) AS score_any, coalesce(sum(score) FILTER (rank > 10), 0) AS later_sum, coalesce(max(score) FILTER (rank > 10), 0) AS later_max,
 1 - coalesce(product(1 - score) FILTER (rank > 10), 1) AS later_any FROM (SELECT * REPLACE (least(greatest(score, 0), 1) AS score) FROM ord) WHERE author IS NOT NULL GROUP BY 1, 2""",
    "score_sum score_max score_any later_sum later_max later_any",
)
def noisy_or_scores(spark, root):
    return profiles.noisy_or(kept(spark, root))


@query("WITH {HIST}\n>>SELECT * FROM history", "thread_start prior_rate history_days", "prior_corrections")
def pair_history(spark, root):
    return history.pair_history(kept(spark, root))


@query(
    """WITH {HIST}, c AS (SELECT p.submission_id, p.author, count(*) FILTER (v.grp = 'other') AS group_0, count(*) FILTER (v.grp = 'public_health_or_news') AS group_1, count(*) FILTER (v.grp = 'skeptical_or_anti_institutional') AS group_2,
 count(*) FILTER (v.grp = 'vaccine_experience_or_health') AS group_3 FROM probe p LEFT JOIN vrec v ON v.author = p.author AND v.created_utc < p.thread_start GROUP BY ALL),
e AS (SELECT *, -list_sum([CASE WHEN x > 0 THEN x / (group_0 + group_1 + group_2 + group_3) * ln(x / (group_0 + group_1 + group_2 + group_3)) ELSE 0 END FOR x IN [group_0, group_1, group_2, group_3]]) AS h FROM c)
>>SELECT submission_id, author, group_0, group_1, group_2, group_3, h / ln(4) AS group_entropy, CASE WHEN group_0 + group_1 + group_2 + group_3 > 0 THEN exp(h) ELSE 0 END AS effective_groups FROM e""",
    "group_entropy effective_groups",
)
def history_diversity(spark, root):
    return history.history_diversity(kept(spark, root), GROUPS)


ENTRY = """{REC}, entry AS (SELECT submission_id, author, min(rank) AS position, min(created_utc) AS entry_time FROM ord WHERE author IS NOT NULL GROUP BY 1, 2),
ec AS MATERIALIZED (SELECT e.submission_id, e.author, e.position, e.entry_time, least(e.position - 1, 10) AS seen_comments, coalesce(sum(o.pred), 0) AS seen_corrections, coalesce(sum(o.hostile), 0) AS seen_hostile, coalesce(sum(o.score), 0) AS seen_score
 FROM entry e LEFT JOIN ord o ON o.submission_id = e.submission_id AND o.rank < e.position AND o.rank <= 10 GROUP BY ALL)"""


@query(f"WITH {ENTRY}\n>>SELECT * FROM ec", "entry_time seen_score", "seen_corrections seen_hostile")
def entry_context(spark, root):
    return history.entry_contexts(kept(spark, root))


@query(
    f"""WITH {ENTRY}, st AS (SELECT submission_id, min(thread_start) AS thread_start FROM ord GROUP BY 1),
p AS (SELECT a.submission_id, a.author, count(b.author) AS n, coalesce(sum(b.seen_comments), 0) AS seen, coalesce(sum(b.seen_corrections), 0) AS c, coalesce(sum(b.seen_hostile), 0) AS h, count(*) FILTER (b.seen_corrections > 0) AS w, count(*) FILTER (b.position = 1) AS o
 FROM ec a JOIN st USING (submission_id) LEFT JOIN ec b ON b.author = a.author AND b.entry_time < st.thread_start GROUP BY 1, 2)
>>SELECT submission_id, author, n AS prior_entries, CASE WHEN seen > 0 THEN c / seen ELSE 0 END AS prior_seen_correction_rate, CASE WHEN seen > 0 THEN h / seen ELSE 0 END AS prior_seen_hostility_rate, CASE WHEN n > 0 THEN w / n ELSE 0 END AS prior_exposed_share,
 CASE WHEN n > 0 THEN o / n ELSE 0 END AS prior_opened_share, CASE WHEN n > 0 THEN seen / n ELSE 0 END AS prior_mean_seen FROM p""",
    "prior_seen_correction_rate prior_seen_hostility_rate prior_exposed_share prior_opened_share prior_mean_seen",
)
def prior_context(spark, root):
    return history.prior_contexts(kept(spark, root))


@query("WITH {SPLIT}\n>>SELECT comment_id, submission_id, side, cutoff FROM split", "cutoff")
def context_split_comments(spark, root):
    return cohort.context_split(kept(spark, root)).select("comment_id", "submission_id", "side", "cutoff")


@query(
    """WITH {HIST}, inside AS (SELECT *, thread_start + 24 * 3600.0 AS cutoff FROM vrec WHERE created_utc <= thread_start + 7 * 86400.0), s AS (SELECT *, CASE WHEN created_utc <= cutoff THEN 'early' ELSE 'later' END AS side FROM inside)
>>SELECT comment_id, submission_id, side, cutoff FROM s WHERE submission_id IN (SELECT submission_id FROM s WHERE side = 'later') AND submission_id IN (SELECT submission_id FROM s WHERE side = 'early')""",
    "cutoff",
)
def context_split_hours(spark, root):
    return cohort.context_split(kept(spark, root), "hours", 24.0).select("comment_id", "submission_id", "side", "cutoff")


@query("WITH {SPLIT}\n>>SELECT * FROM feat", F_D)
def early_features(spark, root):
    r = kept(spark, root)
    return cohort.early_features(cohort.context_split(r), history.pair_history(r))


@query(
    """WITH {SPLIT}
>>SELECT e.submission_id, e.author, e.comment_id, e.subreddit, e.grp, e.pred AS response, e.score AS response_score, e.pair_count AS response_pairs, e.words AS response_words, (e.created_utc - e.thread_start) / 3600.0 AS delay_hours,
 h.* EXCLUDE (submission_id, author, thread_start), f.* EXCLUDE (submission_id) FROM ent e JOIN history h USING (submission_id, author) JOIN feat f ON f.submission_id = e.submission_id WHERE h.prior_comments >= 2 AND h.history_days >= 7""",
    "response_score delay_hours prior_rate history_days " + F_D, "prior_corrections",
)
def first_response_cohort(spark, root):
    return cohort.cohort(kept(spark, root))


@query(
    """WITH {SPLIT}
>>SELECT 'source_threads' AS stage, count(DISTINCT submission_id) AS rows FROM vrec UNION ALL SELECT 'source_comments', count(*) FROM vrec UNION ALL SELECT 'threads_with_both_sides', count(DISTINCT submission_id) FROM split
 UNION ALL SELECT 'threads_with_entrants', count(DISTINCT submission_id) FROM ent UNION ALL SELECT 'first_responses', count(*) FROM ent
 UNION ALL SELECT 'analysis_responses', count(*) FROM ent JOIN history USING (submission_id, author) WHERE prior_comments >= 2 AND history_days >= 7""",
)
def sample_flow(spark, root):
    return cohort.funnel(kept(spark, root))


@query(
    """WITH {SPLIT}, own AS (SELECT submission_id, author, count(*) FILTER (side = 'early') AS own_early, coalesce(sum(pred) FILTER (side = 'early'), 0) AS own_corrections, max((side = 'later')::INT) AS returned FROM split GROUP BY 1, 2 HAVING count(*) FILTER (side = 'early') > 0),
o AS (SELECT *, sum(own_early) OVER (PARTITION BY submission_id) - own_early AS others_early, sum(own_corrections) OVER (PARTITION BY submission_id) - own_corrections AS others_corrections FROM own)
>>SELECT *, CASE WHEN others_early > 0 THEN others_corrections / others_early ELSE 0 END AS others_rate FROM o""",
    "others_rate", "own_corrections others_early others_corrections",
)
def continuation_cohort(spark, root):
    return cohort.continuation(kept(spark, root))


@query(
    """WITH {REC}
>>SELECT submission_id, sum(pred) AS corrections, min(rank) FILTER (pred = 1) AS first_position, avg(score) AS score_mean, max(score) AS score_max, stddev_pop(score) AS score_sd, 1 - (min(rank) FILTER (pred = 1) - 1) / 10 AS earliness
 FROM ord WHERE rank <= 10 GROUP BY 1 HAVING count(*) = 10""",
    "score_mean score_max score_sd earliness", "corrections",
)
def early_variants(spark, root):
    return cohort.early_variants(kept(spark, root))


@query(
    """WITH {REC}
>>SELECT submission_id, (max(created_utc) FILTER (rank = 5) - min(thread_start)) / 3600 AS hours_to_5, (max(created_utc) FILTER (rank = 10) - min(thread_start)) / 3600 AS hours_to_10, (max(created_utc) FILTER (rank = 20) - min(thread_start)) / 3600 AS hours_to_20,
 (max(created_utc) - min(thread_start)) / 3600 AS duration_hours FROM ord GROUP BY 1""",
    "hours_to_5 hours_to_10 hours_to_20 duration_hours",
)
def window_distribution(spark, root):
    return cohort.window_distribution(kept(spark, root))


CLAIM_TERMS = ["masks", "boosters", "steam", "magnets", "ventilation", "natural infection"]
_CLAIM = f"coalesce(regexp_matches(lower(body), '{lexicon.pattern(CLAIM_TERMS)}'), false)"


def _is_claim() -> F.Column:
    return lexicon.has_term(F.col("body"), CLAIM_TERMS) == 1


NEAR = f"""{{REC}}, near AS MATERIALIZED (SELECT submission_id, comment_id, last_value(CASE WHEN {_CLAIM} THEN comment_id END IGNORE NULLS) OVER (PARTITION BY submission_id ORDER BY created_utc, comment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS claim_id FROM rec)"""


@query(f"WITH {NEAR}\n>>SELECT * FROM near")
def nearest_prior_claim(spark, root):
    return pairs.nearest_prior_claim(claims_marked(spark, root), F.col("claim"))


@query("WITH {REC}\n>>SELECT r.comment_id, coalesce(p.author, '') AS parent_author, coalesce(p.pred, 0) AS parent_pred, coalesce(p.body, '') AS parent_body FROM rec r LEFT JOIN rec p ON p.comment_id = r.parent_id")
def parent_context(spark, root):
    return pairs.parent_context(recs(spark, root))


PAIRS = f"""{NEAR}, resp AS (SELECT * FROM rec WHERE candidate = 1 AND author IS NOT NULL),
cp AS (SELECT r.comment_id, CASE WHEN p.comment_id IS NOT NULL THEN r.parent_id ELSE 'submission:' || r.submission_id END AS claim_id, CASE WHEN p.comment_id IS NOT NULL THEN 'parent' ELSE 'title' END AS source, r.created_utc - p.created_utc AS gap FROM resp r LEFT JOIN rec p ON p.comment_id = r.parent_id
 UNION ALL SELECT r.comment_id, n.claim_id, 'nearest', r.created_utc - c.created_utc FROM resp r JOIN near n USING (comment_id) JOIN rec c ON c.comment_id = n.claim_id WHERE n.claim_id IS DISTINCT FROM r.parent_id)"""


@query(f"WITH {PAIRS}\n>>SELECT source || ':' || claim_id || '->' || comment_id AS pair_id, claim_id, comment_id AS response_id, source, gap FROM cp", "gap")
def candidate_pairs(spark, root):
    return pairs.candidate_pairs(claims_marked(spark, root), F.col("claim"))


@query(f"WITH {PAIRS}\n>>SELECT source || ':' || claim_id || '->' || comment_id AS pair_id FROM cp WHERE source || ':' || claim_id || '->' || comment_id NOT IN (SELECT lower(trim(pair_id)) FROM candidate_pairs WHERE pair_id IS NOT NULL)")
def anti_join_excluded(spark, root):
    seen = table(spark, root, "candidate_pairs").select(keys.plain_key(F.col("pair_id")).alias("pair_id")).filter(F.col("pair_id").isNotNull())
    return pairs.candidate_pairs(claims_marked(spark, root), F.col("claim"), seen).select("pair_id")


@query(
    f"""WITH p AS (SELECT {_id('response_id')} AS comment_id, {_id('pair_id')} AS pair_id, max(coalesce(public_correction_score, 0)) AS s FROM candidate_pairs GROUP BY 1, 2 HAVING {_id('response_id')} IS NOT NULL AND {_id('pair_id')} IS NOT NULL)
>>SELECT comment_id, max(s) AS score, count(*) AS pairs, first(pair_id ORDER BY s DESC, pair_id) AS best_pair FROM p GROUP BY 1""".replace("{", "{{").replace("}", "}}"),
    "score",
)
def pair_max_reduce(spark, root):
    return pairs.reduce_to_comments(table(spark, root, "candidate_pairs"))


_MATCH = """list_filter(c.queries, lambda q: len(regexp_extract_all(lower(q), '"([^"]+)"', 1)) > 0 AND len(list_filter(regexp_extract_all(lower(q), '"([^"]+)"', 1), lambda t: NOT contains(lower(coalesce(s.title, '')), t))) = 0)[1]"""


@query(
    f"""WITH s AS (SELECT {_id('submission_id')} AS submission_id, max(title) AS title FROM submissions GROUP BY 1 HAVING {_id('submission_id')} IS NOT NULL), m AS (SELECT c.claim_id, s.submission_id, {_MATCH} AS query FROM s, claims c)
>>SELECT * FROM m WHERE query IS NOT NULL""".replace("{", "{{").replace("}", "}}"),
)
def claim_theta_match(spark, root):
    s = table(spark, root, "submissions").select(keys.plain_id(F.col("submission_id")).alias("submission_id"), "title").filter(F.col("submission_id").isNotNull()).groupBy("submission_id").agg(F.max("title").alias("title"))
    return pairs.claim_matches(s, table(spark, root, "claims"), "title", "submission_id")


@query("WITH {REC}\n>>SELECT comment_id FROM rec WHERE submission_id IN (SELECT submission_id FROM rec WHERE pred = 1)")
def semi_join_threads(spark, root):
    r = recs(spark, root)
    return r.join(r.filter(F.col("pred") == 1).select("submission_id"), "submission_id", "left_semi").select("comment_id")


@query(
    f"""WITH {{REC}}, k AS (SELECT {_id('response_id')} AS r, {_id('submission_id')} AS s FROM candidate_pairs)
>>SELECT comment_id, (comment_id IN (SELECT r FROM k WHERE r IS NOT NULL))::INT AS seen_response, (submission_id IN (SELECT s FROM k WHERE s IS NOT NULL))::INT AS seen_thread FROM rec""",
)
def existence_flags(spark, root):
    known = table(spark, root, "candidate_pairs").select(keys.plain_id(F.col("response_id")).alias("comment_id"), keys.plain_id(F.col("submission_id")).alias("submission_id"))
    return pairs.membership(recs(spark, root), known, {"response": "comment_id", "thread": "submission_id"}).select("comment_id", "seen_response", "seen_thread")


@query("WITH {REC}\n>>SELECT comment_id, words, hostile, anti, left({C}, 80) AS short, starts_with(body, '>')::INT AS quoted, substr(sha256(comment_id), 1, 16) AS hash FROM rec".replace("{C}", _compact("body").replace("{", "{{").replace("}", "}}")))
def text_features(spark, root):
    b = F.col("body")
    return recs(spark, root).select("comment_id", "words", "hostile", "anti", text.compact(b, 80).alias("short"), b.startswith(">").cast("int").alias("quoted"), keys.hash_id(F.col("comment_id")).alias("hash"))


@query("WITH {REC}\n>>SELECT 'hostility' AS lexicon, sum(hostile) AS matches, count(*) AS comments, avg(hostile) AS rate FROM rec UNION ALL SELECT 'anti_institutional', sum(anti), count(*), avg(anti) FROM rec", "rate", "matches")
def lexicon_diagnostics(spark, root):
    r = recs(spark, root)
    long = r.select(F.explode(F.array(F.struct(F.lit("hostility").alias("lexicon"), F.col("hostile").alias("m")), F.struct(F.lit("anti_institutional").alias("lexicon"), F.col("anti").alias("m")))).alias("x")).select("x.*")
    return long.groupBy("lexicon").agg(F.sum("m").alias("matches"), F.count(F.lit(1)).alias("comments"), F.avg("m").alias("rate"))


@query("WITH {REC}\n>>SELECT CASE WHEN score >= 0 AND score < 0.25 THEN 'low' WHEN score >= 0.25 AND score < 0.5 THEN 'mid' WHEN score >= 0.5 AND score <= 1.0000001 THEN 'high' ELSE 'unknown' END AS bin, count(*) AS rows FROM rec GROUP BY 1")
def score_bins(spark, root):
    b = text.score_bin(F.col("score"), [0.0, 0.25, 0.5, 1.0], ["low", "mid", "high"])
    return recs(spark, root).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


@query("WITH {REC}\n>>SELECT grp, pred::VARCHAR AS pred, count(*) AS rows FROM rec GROUP BY 1, 2")
def strata_counts(spark, root):
    return sets.counts(recs(spark, root), "grp", "pred")


@query("WITH {REC}\n>>SELECT comment_id, grp FROM (SELECT comment_id, grp, row_number() OVER (PARTITION BY grp, candidate ORDER BY md5(comment_id || ':7'), comment_id) AS k FROM rec) WHERE k <= 20")
def stratified_sample_md5(spark, root):
    return sampling.stratified(recs(spark, root), ["grp", "candidate"], "comment_id", 20, 7).select("comment_id", "grp")


@query(
    """WITH {REC}, a AS (SELECT comment_id, 'high' AS component FROM rec WHERE score >= 0.6 ORDER BY score DESC, comment_id LIMIT 30),
b AS (SELECT comment_id, 'hostile' FROM rec WHERE hostile = 1 AND comment_id NOT IN (SELECT comment_id FROM a) ORDER BY score DESC, comment_id LIMIT 20)
>>SELECT * FROM a UNION ALL SELECT * FROM b""",
)
def quota_sample(spark, root):
    return sampling.quota(recs(spark, root), {"high": (F.col("score") >= 0.6, 30), "hostile": (F.col("hostile") == 1, 20)}, "comment_id", F.col("score")).select("comment_id", "component")


@query(
    """WITH {REC}, p AS (SELECT comment_id, submission_id, score, row_number() OVER (PARTITION BY submission_id ORDER BY score DESC, comment_id) AS k FROM rec WHERE pred = 1)
>>SELECT comment_id, 'corrections' AS component FROM p WHERE k <= 2 ORDER BY score DESC, comment_id LIMIT 60""",
)
def quota_sample_capped(spark, root):
    return sampling.quota_capped(recs(spark, root), {"corrections": (F.col("pred") == 1, 60)}, "comment_id", "submission_id", 2, F.col("score")).select("comment_id", "component")


@query("WITH {REC}\n>>SELECT comment_id FROM rec ORDER BY md5(comment_id || ':3'), comment_id LIMIT 100")
def simple_sample(spark, root):
    return sampling.simple(recs(spark, root), "comment_id", 100, 3).select("comment_id")


@query(
    """WITH {REC}, a AS (SELECT comment_id, submission_id, ('0x' || substr(md5(submission_id || ':5'), 1, 8))::BIGINT / 4294967296.0 AS x FROM rec)
>>SELECT comment_id, CASE WHEN x < 0.7 THEN 'train' WHEN x < 0.7 + 0.15 THEN 'validation' ELSE 'test' END AS split FROM a""",
)
def group_split(spark, root):
    return sampling.group_split(recs(spark, root), "submission_id", {"train": 0.7, "validation": 0.15, "test": 0.15}, 5).select("comment_id", "split")


@query("WITH {REC}, a AS (SELECT comment_id, (row_number() OVER (PARTITION BY pred ORDER BY md5(comment_id || ':9'), comment_id) - 1) / count(*) OVER (PARTITION BY pred) AS x FROM rec)\n>>SELECT comment_id, CASE WHEN x < 0.8 THEN 'train' ELSE 'test' END AS split FROM a")
def label_split(spark, root):
    return sampling.label_split(recs(spark, root), "pred", "comment_id", {"train": 0.8, "test": 0.2}, 9).select("comment_id", "split")


@query(
    """WITH u AS (SELECT annotation_id, pair_id, 0 AS f FROM candidate_pairs WHERE pair_source = 'title' UNION ALL SELECT annotation_id, pair_id, 1 FROM candidate_pairs), k AS (SELECT *, coalesce(nullif(trim(pair_id), ''), nullif(trim(annotation_id), '')) AS key FROM u)
>>SELECT annotation_id, pair_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY f, annotation_id) AS n FROM k) WHERE key IS NULL OR n = 1""",
)
def union_first_wins(spark, root):
    p = table(spark, root, "candidate_pairs")
    return sets.union_first_wins([p.filter(F.col("pair_source") == "title").select("annotation_id", "pair_id"), p.select("annotation_id", "pair_id")], ["pair_id", "annotation_id"], "annotation_id")


@query("\n>>SELECT comment_id, count(DISTINCT lower(trim(manual_label))) AS labels, min(lower(trim(manual_label))) AS first_label, max(lower(trim(manual_label))) AS last_label FROM comment_labels WHERE manual_label IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(trim(manual_label))) > 1")
def label_conflicts(spark, root):
    return sets.conflicts(table(spark, root, "comment_labels"), "comment_id", "manual_label")


EVAL = "{REC}, ev AS (SELECT round(score, 3) AS score, hostile::INT AS y, grp, pred FROM rec)"


def _eval(spark, root):
    return recs(spark, root).select(F.round("score", 3).alias("score"), F.col("hostile").cast("int").alias("y"), "grp", "pred")


_TM = """count(*) AS n, count(*) FILTER (s AND y = 1) AS tp, count(*) FILTER (s AND y = 0) AS fp, count(*) FILTER (NOT s AND y = 1) AS fn, count(*) FILTER (NOT s AND y = 0) AS tn, avg((score - y) ** 2) AS brier"""
_TM2 = """(tp + fn) / n AS prevalence, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1"""


@query(f"WITH {EVAL}\n>>SELECT *, {_TM2} FROM (SELECT {_TM} FROM (SELECT *, score >= 0.5 AS s FROM ev))", "brier prevalence precision recall f1")
def binary_metrics(spark, root):
    return metrics.threshold_metrics(_eval(spark, root), 0.5)


@query(f"WITH {EVAL}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.7])::DOUBLE AS threshold)\n>>SELECT *, {_TM2} FROM (SELECT threshold, {_TM} FROM (SELECT *, score >= threshold AS s FROM ev, t) GROUP BY threshold)", "threshold brier prevalence precision recall f1")
def threshold_sweep(spark, root):
    return metrics.sweep(_eval(spark, root), [0.1, 0.2, 0.3, 0.5, 0.7])


@query(
    f"""WITH {EVAL}, g AS (SELECT score, sum(y) AS pos, count(*) AS n FROM ev GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS above FROM g)
>>SELECT sum(n) AS n, sum(pos) AS positives, sum(pos * tp / above) / sum(pos) AS average_precision, (SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END * a.pos * (b.n - b.pos)) FROM g a, g b) / (sum(pos) * (sum(n) - sum(pos))) AS roc_auc FROM c""",
    "average_precision roc_auc", "n positives",
)
def ranking_metrics(spark, root):
    return metrics.ranking(_eval(spark, root))


@query(
    f"""WITH {EVAL}, g AS (SELECT score, sum(y) AS pos, count(*) AS n FROM ev GROUP BY 1), c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS above, sum(pos) OVER () AS p FROM g),
m AS (SELECT score AS threshold, 2 * tp / (above + p) AS f1, tp / above AS precision, tp / p AS recall FROM c)
>>SELECT threshold, f1, precision, recall FROM m ORDER BY f1 DESC, precision DESC, recall DESC, threshold DESC LIMIT 1""",
    "threshold f1 precision recall",
)
def best_threshold(spark, root):
    return metrics.best_threshold(_eval(spark, root))


@query(
    f"""WITH {EVAL}, g AS (SELECT greatest(ceil(score * 10), 1)::INT AS bin, count(*) AS n, avg(score) AS mean_score, avg(y) AS rate FROM ev GROUP BY 1)
>>SELECT *, abs(mean_score - rate) AS gap, abs(mean_score - rate) * n / sum(n) OVER () AS ece_part FROM g""",
    "mean_score rate gap ece_part",
)
def calibration_bins(spark, root):
    return metrics.calibration(_eval(spark, root))


@query(
    f"""WITH {EVAL}, l AS (SELECT *, 'group' AS dimension, grp AS subgroup FROM ev UNION ALL SELECT *, 'pred', pred::VARCHAR FROM ev), m AS (SELECT dimension, subgroup, {_TM} FROM (SELECT *, score >= 0.5 AS s FROM l) GROUP BY 1, 2)
>>SELECT dimension, subgroup, n, tp, fp, fn, tn, brier, {_TM2} FROM m WHERE n >= 30 AND tp + fn > 0 AND fp + tn > 0""",
    "brier prevalence precision recall f1",
)
def subgroup_metrics(spark, root):
    return metrics.subgroups(_eval(spark, root), {"group": F.col("grp"), "pred": F.col("pred")}, 0.5).drop("average_precision", "roc_auc")


@query(f"WITH {EVAL}\n>>SELECT y, count(*) FILTER (score < 0.5) AS predicted_0, count(*) FILTER (score >= 0.5) AS predicted_1 FROM ev GROUP BY 1")
def confusion(spark, root):
    return _eval(spark, root).groupBy("y").agg(F.count_if(F.col("score") < 0.5).alias("predicted_0"), F.count_if(F.col("score") >= 0.5).alias("predicted_1"))


_DESC = "count({0}) AS n, avg({0}) AS mean, stddev_samp({0}) AS sd, min({0})::DOUBLE AS min, quantile_cont({0}, 0.25) AS q1, quantile_cont({0}, 0.5) AS median, quantile_cont({0}, 0.75) AS q3, max({0})::DOUBLE AS max"


@query("WITH {THREADS}\n>>" + " UNION ALL ".join(f"SELECT '{c}' AS variable, {_DESC.format(c)} FROM thread" for c in ("comments", "authors", "hostility_rate")), "mean sd min q1 median q3 max")
def descriptives(spark, root):
    return metrics.describe(profiles.thread_profiles(kept(spark, root)), ["comments", "authors", "hostility_rate"])


@query("WITH {THREADS}\n>>SELECT 'comments' AS a, 'authors' AS b, corr(comments, authors) AS r FROM thread UNION ALL SELECT 'comments', 'max_score', corr(comments, max_score) FROM thread UNION ALL SELECT 'authors', 'max_score', corr(authors, max_score) FROM thread", "r")
def correlation_matrix(spark, root):
    return metrics.correlations(profiles.thread_profiles(kept(spark, root)), ["comments", "authors", "max_score"])


@query("WITH {THREADS}\n>>SELECT submission_id, (comments - (SELECT avg(comments) FROM thread)) / (SELECT stddev_pop(comments) FROM thread) AS comments_z, (max_score - (SELECT avg(max_score) FROM thread)) / (SELECT stddev_pop(max_score) FROM thread) AS max_score_z FROM thread", "comments_z max_score_z")
def standardize(spark, root):
    return metrics.standardise(profiles.thread_profiles(kept(spark, root)), ["comments", "max_score"]).select("submission_id", "comments_z", "max_score_z")


@query("WITH {THREADS}, p AS (SELECT subreddit AS term, 1 / (1 + sum(corrections)) AS p FROM thread GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, term) AS k, count(*) OVER () AS n FROM p)\n>>SELECT term, p, least(min(p * n / k) OVER (ORDER BY k DESC), 1) AS q FROM r", "p q")
def bh_adjust(spark, root):
    t = profiles.thread_profiles(kept(spark, root)).groupBy(F.col("subreddit").alias("term")).agg((1 / (1 + F.sum("corrections"))).alias("p"))
    return metrics.benjamini_hochberg(t)


@query("WITH {THREADS}\n>>SELECT submission_id, authors, comments FROM thread WHERE corrections = 0 ORDER BY authors DESC, comments DESC, submission_id LIMIT 50")
def topk_threads(spark, root):
    t = profiles.thread_profiles(kept(spark, root)).filter(F.col("corrections") == 0)
    return t.orderBy(F.desc("authors"), F.desc("comments"), "submission_id").limit(50).select("submission_id", "authors", "comments")


@query("WITH {REC}\n>>SELECT count(*) AS comments, count(DISTINCT submission_id) AS threads, count(DISTINCT author) AS authors, sum(pred) AS corrections, sum(candidate) AS candidates, min(created_utc) AS first, max(created_utc) AS last FROM rec", "first last", "corrections candidates")
def global_summary(spark, root):
    return recs(spark, root).agg(F.count(F.lit(1)).alias("comments"), F.count_distinct("submission_id").alias("threads"), F.count_distinct("author").alias("authors"), F.sum("pred").alias("corrections"), F.sum("candidate").alias("candidates"), F.min("created_utc").alias("first"), F.max("created_utc").alias("last"))


# Relations of the opening, and the analysis frame.
def rel_kept(spark: SparkSession, root: str) -> DataFrame:
    """The records with relation vectors, without texts, written once."""
    return Scratch(spark, "relations").keep(relations.with_relations(recs(spark, root)).drop("body", "title"))


_CUES = {
    "denial": "candidate = 1", "evidence": r"regexp_matches(body, '\d+(\.\d+)?\s?%|\b\d{{2,}}\b')", "quotation": "starts_with(body, '>') OR contains(body, chr(10) || '>')", "elaboration": "words >= 50", "question": "contains(body, '?')",
    "institutions": "anti = 1", "hostility": "hostile = 1",
}
_T = relations.TYPES
_ON = ", ".join(f"coalesce(({c})::INT, 0) AS on_{n}" for n, c in _CUES.items())
_N = " + ".join(f"on_{n}" for n in _CUES)
_REL = ", ".join(f"s * {'(n = 0)::INT' if t == 'other' else 'on_' + t} / greatest(n, 1) AS rel_{t}" for t in _T)
REL = f""",
cue AS (SELECT comment_id AS cid, least(greatest(coalesce(score, 0), 0), 1) AS s, (pair_count > 0)::INT AS rel_available, {_ON} FROM rec),
rel AS MATERIALIZED (SELECT cid, rel_available, {_REL}, 1 - s AS rel_none FROM (SELECT *, {_N} AS n FROM cue))"""


def _h(v: str) -> str:
    return f"(-coalesce(list_sum([p * ln(p) FOR p IN {v} IF p > 0]), 0))"


def _hn(v: str, k: int) -> str:
    return f"(CASE WHEN list_sum({v}) > 0 THEN -list_sum([p / list_sum({v}) * ln(p / list_sum({v})) FOR p IN {v} IF p > 0]) / ln({k}) ELSE 0 END)"


_MEANS = ", ".join(f"avg(rel_{t}) AS early_mean_{t}" for t in (*_T, "none"))
_M9 = "[" + ", ".join(f"early_mean_{t}" for t in (*_T, "none")) + "]"
ERL = f"""{REL},
erl AS MATERIALIZED (SELECT submission_id, {_h(_M9)} / ln(9) AS early_relation_diversity, early_relation_coverage, early_additional FROM (
  SELECT submission_id, {_MEANS}, avg(rel_available) AS early_relation_coverage, greatest(sum(pred) - 1, 0)::BIGINT AS early_additional FROM split JOIN rel ON cid = comment_id WHERE side = 'early' GROUP BY 1))"""


@query("WITH {SPLIT}" + ERL + "\n>>SELECT * FROM erl", "early_relation_diversity early_relation_coverage")
def early_relations(spark, root):
    return relations.early_relations(cohort.context_split(rel_kept(spark, root)))


_V9 = "[" + ", ".join(f"rel_{t}" for t in (*_T, "none")) + "]"
_V8 = "[" + ", ".join(f"rel_{t}" for t in _T) + "]"
_VARIANT_D = "correction_earliness score_of_ten max_score mean_candidates soft_diversity soft_renormalised hard_diversity relation_only_diversity corrective_diversity other_diversity " + " ".join(f"early_mean_{t}" for t in _T)


@query(
    f"""WITH {{REC}}{REL},
h AS (SELECT ord.submission_id, ord.pred, ord.score, ord.rank, ord.pair_count, rel.*, list_position({_V9}, list_max({_V9})) AS hard, CASE WHEN rel_available = 1 THEN list_position({_V8}, list_max({_V8})) END AS own FROM ord JOIN rel ON cid = comment_id WHERE rank <= 10),
g AS (SELECT submission_id, {_MEANS}, [{', '.join(f"coalesce(avg(rel_{t}) FILTER (rel_available = 1), 0)" for t in _T)}] AS alone, [{', '.join(f"count(*) FILTER (hard = {k + 1})" for k in range(9))}] AS counts, count(DISTINCT own) AS relation_only_richness, count(DISTINCT hard) AS hard_richness,
  sum(pred)::BIGINT AS corrections, greatest(sum(pred) - 1, 0)::BIGINT AS additional_corrections, coalesce(min(rank) FILTER (pred = 1), 0)::BIGINT AS first_position, (10 - min(rank) FILTER (pred = 1)) / 9 AS correction_earliness, sum(score) AS score_of_ten, max(score) AS max_score, avg(pair_count) AS mean_candidates
  FROM h GROUP BY 1 HAVING count(*) = 10)
>>SELECT * EXCLUDE (alone, counts, early_mean_none), {_h(_M9)} / ln(9) AS soft_diversity, {_hn(_M9, 9)} AS soft_renormalised, {_hn('counts', 9)} AS hard_diversity, {_hn('alone', 8)} AS relation_only_diversity,
 {_hn('[' + ', '.join(f'early_mean_{t}' for t in _T[:5]) + ']', 5)} AS corrective_diversity, {_hn('[' + ', '.join(f'early_mean_{t}' for t in _T[5:]) + ']', 3)} AS other_diversity FROM g""",
    _VARIANT_D,
)
def early_relation_variants(spark, root):
    """The mean score comes out as the sum of the ten: means of ten six-digit scores lie on the edge of rounding."""
    v = relations.early_relation_variants(rel_kept(spark, root))
    return v.withColumn("score_of_ten", F.col("mean_score") * 10).drop("mean_score")


_Z = ", ".join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) AS {c}_z" for c in relations.STANDARDISED)
COHORT = """, coh AS (SELECT e.submission_id, e.author, e.comment_id, e.subreddit, e.grp, e.pred AS response, e.score AS response_score, e.pair_count AS response_pairs, e.words AS response_words, (e.created_utc - e.thread_start) / 3600.0 AS delay_hours,
  h.* EXCLUDE (submission_id, author, thread_start), f.* EXCLUDE (submission_id) FROM ent e JOIN history h USING (submission_id, author) JOIN feat f ON f.submission_id = e.submission_id WHERE h.prior_comments >= 2 AND h.history_days >= 7)"""


@query(
    "WITH {SPLIT}" + ERL + COHORT + f""",
a AS (SELECT coh.*, erl.* EXCLUDE (submission_id), ln(1 + prior_comments) AS log_prior, ln(1 + delay_hours) AS log_delay, ln(1 + response_words) AS log_words, least(prior_groups, 3)::BIGINT AS prior_groups_capped, least(prior_subreddits, 4)::BIGINT AS prior_subreddits_capped,
  CASE WHEN prior_cross_group = 1 THEN 'across_groups' WHEN prior_cross_subreddit = 1 THEN 'across_subreddits' ELSE 'one_subreddit' END AS access_pattern, CASE WHEN prior_comments < 2 THEN 'limited prior record' WHEN prior_cross_subreddit = 1 THEN 'multiple prior subreddits' ELSE 'one prior subreddit' END AS participation,
  CASE WHEN early_ambient_hostility + early_directed_rate > 0 THEN 'any hostile language' ELSE 'no hostile language' END AS hostile_opening FROM coh JOIN erl USING (submission_id))
>>SELECT *, {_Z} FROM a""",
    "response_score delay_hours prior_rate history_days early_relation_diversity early_relation_coverage log_prior log_delay log_words " + F_D + " " + " ".join(f"{c}_z" for c in relations.STANDARDISED), "prior_corrections",
)
def analysis_frame(spark, root):
    """The first-response cohort with every covariate of the models."""
    r = rel_kept(spark, root)
    return relations.analysis_frame(cohort.cohort(r), relations.early_relations(cohort.context_split(r)))


# Samples with caps, fills, flags and reasons.
def pair_rows(spark: SparkSession, root: str) -> DataFrame:
    """Candidate pairs, one row an id (the greatest of each column), written once."""
    p = table(spark, root, "candidate_pairs")
    cols = {
        "response_id": keys.plain_id(F.col("response_id")), "submission_id": keys.plain_id(F.col("submission_id")), "component": F.col("sample_component"), "pair_source": F.col("pair_source"), "body": F.col("response_body"), "score": F.coalesce("public_correction_score", F.lit(0.0)),
        "cue": F.coalesce("response_has_correction_cue", F.lit(0)), "claim_cue": F.coalesce("claim_has_misinfo_cue", F.lit(0)), "sarcasm": F.coalesce("response_has_sarcasm", F.lit(0)), "quote": F.coalesce("response_has_quote", F.lit(0)),
    }
    one = p.select(keys.plain_id(F.col("pair_id")).alias("pair_id"), *[c.alias(n) for n, c in cols.items()]).filter(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(*[F.max(n).alias(n) for n in cols])
    return Scratch(spark, "pairs").keep(one.withColumn("tie", sampling.shuffle_key("pair_id", 7)))


PP = f"""pp AS MATERIALIZED (SELECT pair_id, response_id, submission_id, component, pair_source, body, score, cue, claim_cue, sarcasm, quote, md5(pair_id || ':7') AS tie FROM (
  SELECT {_id('pair_id')} AS pair_id, max({_id('response_id')}) AS response_id, max({_id('submission_id')}) AS submission_id, max(sample_component) AS component, max(pair_source) AS pair_source, max(response_body) AS body, max(coalesce(public_correction_score, 0)) AS score,
   max(coalesce(response_has_correction_cue, 0)) AS cue, max(coalesce(claim_has_misinfo_cue, 0)) AS claim_cue, max(coalesce(response_has_sarcasm, 0)) AS sarcasm, max(coalesce(response_has_quote, 0)) AS quote FROM candidate_pairs GROUP BY 1) WHERE pair_id IS NOT NULL)"""
QUOTAS = "cue_pairs=30,hard_negative=20"
_ORDER = "claim_cue DESC, cue DESC, score DESC, pair_source, tie"


def _accept(name: str, pool: str, used: str, label: str, quota: int) -> str:
    """SQL of one component: the cap of a response, then that of its thread, then the quota, less what ``used`` holds."""
    return f"""{name}a AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY coalesce(response_id, '') ORDER BY {_ORDER}) + (SELECT count(*) FROM {used} u WHERE coalesce(u.response_id, '') = coalesce(p.response_id, '')) AS k FROM pp p WHERE {pool} AND pair_id NOT IN (SELECT pair_id FROM {used})) WHERE k <= 2),
{name}b AS (SELECT * FROM (SELECT a.* EXCLUDE (k), row_number() OVER (PARTITION BY coalesce(submission_id, '') ORDER BY {_ORDER}) + (SELECT count(*) FROM {used} u WHERE coalesce(u.submission_id, '') = coalesce(a.submission_id, '')) AS k FROM {name}a a) WHERE k <= 3),
{name}c AS (SELECT pair_id, response_id, submission_id, '{label}' AS taken_as, row_number() OVER (ORDER BY {_ORDER}) AS place FROM {name}b ORDER BY {_ORDER} LIMIT {quota}),
{name} AS MATERIALIZED (SELECT * FROM {used} UNION ALL SELECT * FROM {name}c)"""


@query(
    "WITH " + PP.replace("{", "{{").replace("}", "}}") + ", s0 AS (SELECT pair_id, response_id, submission_id, '' AS taken_as, 0::BIGINT AS place FROM pp WHERE false), " + _accept("s1", "component = 'cue_pairs'", "s0", "cue_pairs", 30) + ", "
    + _accept("s2", "component = 'hard_negative'", "s1", "hard_negative", 20) + ", " + _accept("s3", "true", "s2", "fill", 40)
    + """, n AS (SELECT pair_id, taken_as, row_number() OVER (ORDER BY CASE taken_as WHEN 'cue_pairs' THEN 0 WHEN 'hard_negative' THEN 1 ELSE 2 END, place) AS k FROM s3)
>>SELECT 'RPS' || lpad(k::VARCHAR, 5, '0') AS annotation_id, pair_id, taken_as, '' AS is_correction_relation, '' AS relation_type FROM n WHERE k <= (SELECT greatest(90, count(*) FILTER (taken_as <> 'fill')) FROM n)"""
)
def pair_sample(spark, root):
    """Ordered components under two caps, filled to 90, with ids and blank fields to fill in."""
    order = [F.desc("claim_cue"), F.desc("cue"), F.desc("score"), F.asc("pair_source"), F.asc("tie")]
    pools = {n: (F.col("component") == n, q) for n, q in sampling.parse_quotas(QUOTAS).items()}
    taken = sampling.greedy(pair_rows(spark, root), pools, "pair_id", {"response_id": 2, "submission_id": 3}, order, 90)
    return sampling.annotation_sheet(taken, "RPS", ["is_correction_relation", "relation_type"]).select("annotation_id", "pair_id", "taken_as", "is_correction_relation", "relation_type")


_STRATUM = "CASE WHEN score >= 0 AND score < 0.25 THEN 'low' WHEN score >= 0.25 AND score < 0.5 THEN 'mid' WHEN score >= 0.5 AND score <= 1.0000001 THEN 'high' ELSE 'unknown' END"


@query(
    "WITH " + PP.replace("{", "{{").replace("}", "}}") + f""", r AS (SELECT *, row_number() OVER (PARTITION BY pair_source, {_STRATUM} ORDER BY tie, pair_id) AS k FROM pp)
>>SELECT pair_id, CASE WHEN k > 12 THEN 'fill' ELSE 'stratum' END AS phase FROM r ORDER BY (k > 12)::INT, CASE WHEN k > 12 THEN abs(score - 0.5) ELSE 0 END, tie, pair_id LIMIT 100"""
)
def uncertainty_sample(spark, root):
    """12 a stratum of source and score bin, then the most uncertain ones up to 100."""
    p = pair_rows(spark, root).withColumn("bin", text.score_bin(F.col("score"), [0.0, 0.25, 0.5, 1.0], ["low", "mid", "high"]))
    return sampling.stratified_fill(p, ["pair_source", "bin"], "pair_id", 12, 100, "score", 7).select("pair_id", "phase")


@query(
    "WITH " + PP.replace("{", "{{").replace("}", "}}") + f""", r AS (SELECT *, row_number() OVER (PARTITION BY cue, pair_source, {_STRATUM} ORDER BY tie, pair_id) AS k FROM pp),
a AS (SELECT pair_id, cue, 'stratum' AS phase, row_number() OVER (PARTITION BY cue ORDER BY tie, pair_id) AS n FROM r WHERE k <= 8), a1 AS MATERIALIZED (SELECT * FROM a WHERE n <= CASE cue WHEN 1 THEN 36 ELSE 24 END),
b AS (SELECT pair_id, cue, 'flag' AS phase, row_number() OVER (PARTITION BY cue ORDER BY tie, pair_id) + (SELECT count(*) FROM a1 WHERE a1.cue = r.cue) AS n FROM r WHERE pair_id NOT IN (SELECT pair_id FROM a1)), b1 AS MATERIALIZED (SELECT * FROM a1 UNION ALL SELECT * FROM b WHERE n <= CASE cue WHEN 1 THEN 36 ELSE 24 END),
c AS (SELECT pair_id, 'fill' AS phase, row_number() OVER (ORDER BY tie, pair_id) + (SELECT count(*) FROM b1) AS n FROM r WHERE pair_id NOT IN (SELECT pair_id FROM b1))
>>SELECT pair_id, phase FROM b1 UNION ALL SELECT pair_id, phase FROM c WHERE n <= 60"""
)
def flag_balanced_sample(spark, root):
    """36 pairs with the cue and 24 without, at most 8 a stratum at first, filled within the flag and then from all."""
    p = pair_rows(spark, root).withColumn("bin", text.score_bin(F.col("score"), [0.0, 0.25, 0.5, 1.0], ["low", "mid", "high"]))
    return sampling.flag_balanced(p, "cue", {1: 36, 0: 24}, ["pair_source", "bin"], 8, "pair_id", "tie", 60).select("pair_id", "phase")


@query(
    "WITH " + PP.replace("{", "{{").replace("}", "}}") + """, a AS (SELECT pair_id, 'low_score_cue' AS component FROM pp WHERE cue = 1 AND score < 0.4 ORDER BY score, tie LIMIT 20),
b AS (SELECT pair_id, 'near_threshold' AS component FROM pp WHERE pair_id NOT IN (SELECT pair_id FROM a) ORDER BY abs(score - 0.5), tie LIMIT 20), ab AS MATERIALIZED (SELECT * FROM a UNION ALL SELECT * FROM b),
c AS (SELECT pair_id, 'random_calibration' AS component FROM pp WHERE pair_id NOT IN (SELECT pair_id FROM ab) ORDER BY tie LIMIT 15), abc AS MATERIALIZED (SELECT * FROM ab UNION ALL SELECT * FROM c),
d AS (SELECT pair_id, 'fallback_high_score' AS component FROM pp WHERE pair_id NOT IN (SELECT pair_id FROM abc) ORDER BY score DESC, tie LIMIT greatest(0, 70 - (SELECT count(*) FROM abc)))
>>SELECT * FROM abc UNION ALL SELECT * FROM d"""
)
def hard_negative_sample(spark, root):
    """Ordered components without caps, each in its own order, first come first served, then the best scores up to 70."""
    pools = {
        "low_score_cue": ((F.col("cue") == 1) & (F.col("score") < 0.4), 20, [F.asc("score"), F.asc("tie")]),
        "near_threshold": (F.lit(True), 20, [F.abs(F.col("score") - 0.5).asc(), F.asc("tie")]),
        "random_calibration": (F.lit(True), 15, [F.asc("tie")]),
    }
    return sampling.components(pair_rows(spark, root), pools, "pair_id", 70, ("fallback_high_score", [F.desc("score"), F.asc("tie")])).select("pair_id", "component")


_SHORT = "len(trim(coalesce(body, ''))) < 80"


@query(
    "WITH " + PP.replace("{", "{{").replace("}", "}}") + f""", t AS (SELECT pair_id, list_filter([CASE WHEN score >= 0.5 AND cue = 0 THEN 'high_score_without_cue' END, CASE WHEN score <= 0.2 AND (cue = 1 OR {_SHORT}) THEN 'low_score_in_context' END, CASE WHEN quote = 1 OR sarcasm = 1 THEN 'quote_or_sarcasm' END,
 CASE WHEN {_SHORT} THEN 'short' END, CASE WHEN abs(score - 0.5) <= 0.05 THEN 'near_threshold' END], lambda x: x IS NOT NULL) AS r FROM pp)
>>SELECT pair_id, r[1] AS primary_reason, array_to_string(r, '|') AS reasons, len(r)::INT AS n_reasons FROM t WHERE len(r) > 0"""
)
def reason_tags(spark, root):
    """Every reason to look at a pair again, the first being its primary one."""
    short = F.length(F.trim(F.coalesce("body", F.lit("")))) < 80
    why = {
        "high_score_without_cue": (F.col("score") >= 0.5) & (F.col("cue") == 0), "low_score_in_context": (F.col("score") <= 0.2) & ((F.col("cue") == 1) | short), "quote_or_sarcasm": (F.col("quote") == 1) | (F.col("sarcasm") == 1), "short": short,
        "near_threshold": F.abs(F.col("score") - 0.5) <= 0.05,
    }
    return sampling.tagged(pair_rows(spark, root), why).select("pair_id", "primary_reason", "reasons", "n_reasons")


@query(
    "WITH " + PP.replace("{", "{{").replace("}", "}}") + f""", e AS (SELECT pair_id, (score + cue + claim_cue) / 3 AS ensemble_score, {_terms('body', lexicon.ANTI_INSTITUTIONAL)}::INT AS institutions_like, {_terms('body', lexicon.HOSTILITY)}::INT AS hostile_like,
 coalesce(regexp_matches(body, '\\d+(\\.\\d+)?\\s?%|\\b\\d{{{{2,}}}}\\b')::INT, 0) AS numeric_like, (len(trim(coalesce(body, ''))) >= 80)::INT AS long_enough FROM pp)
>>SELECT *, institutions_like + hostile_like + numeric_like + long_enough AS priority FROM e""",
    "ensemble_score",
)
def row_enrichment(spark, root):
    """Lexicon and surface flags, the mean of several scores and an additive priority."""
    p, b = pair_rows(spark, root), F.col("body")
    flags = {"institutions_like": lexicon.has_term(b, lexicon.ANTI_INSTITUTIONAL), "hostile_like": lexicon.has_term(b, lexicon.HOSTILITY), "numeric_like": text.has_number(b), "long_enough": (F.length(F.trim(F.coalesce(b, F.lit("")))) >= 80).cast("int")}
    return sampling.enriched(p, ["score", "cue", "claim_cue"], flags).select("pair_id", "ensemble_score", *flags, "priority")
