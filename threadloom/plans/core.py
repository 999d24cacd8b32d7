"""Queries of the operators that are not bound to texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import eager, hierarchy, references
from threadloom.runtime import Scratch
from threadloom.sources.tables import table


def p3_profile(spark: SparkSession, root: str) -> DataFrame:
    """Per author, thread and subreddit: comments, submissions and their join, from states."""
    comments, subs = table(spark, root, "comments"), table(spark, root, "submissions")
    keys = {k: F.col(k) for k in ("author", "submission_id", "subreddit")}
    return eager.eager_join_profile(comments, subs, keys, keys, {"level": F.col("level"), "created": F.col("created_utc")})


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """The keys that make the imbalance, read from the whole result per key."""
    total = table(spark, root, "comments").count()
    return eager.heavy_keys(Scratch(spark, "profile").keep(p3_profile(spark, root)), total)


def p3_key_results(spark: SparkSession, root: str) -> DataFrame:
    cols = ["key_field", "key_value", "left_rows", "right_rows", "joined_rows", "left_level_sum", "joined_left_level_sum"]
    return p3_profile(spark, root).select(cols)


def p3_rollup(spark: SparkSession, root: str) -> DataFrame:
    return eager.roll_up(p3_profile(spark, root))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return hierarchy.findings(hierarchy.comment_hierarchy(table(spark, root, "comments")))


def p4_paths(spark: SparkSession, root: str) -> DataFrame:
    return hierarchy.comment_hierarchy(table(spark, root, "comments"), every_path=True)


def p4_path_texts(spark: SparkSession, root: str) -> DataFrame:
    """As ``p4_paths``, the ids of a path joined by a slash, for engines and files without lists."""
    return p4_paths(spark, root).withColumn("path", F.array_join("path", "/"))


def p4_descendants(spark: SparkSession, root: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.comment_hierarchy(table(spark, root, "comments"), every_path=True))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return references.orphan_references(table(spark, root, "comments"), table(spark, root, "submissions"))


def p5_report(spark: SparkSession, root: str) -> DataFrame:
    return references.orphan_report(p5_found(spark, root))


QUERIES = {f.__name__: f for f in (p3_found, p3_key_results, p3_rollup, p4_found, p4_paths, p4_path_texts, p4_descendants, p5_found, p5_report)}

_KEY = "lower(trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))"
_ID = "nullif(regexp_replace(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '^t[13]_', ''), '')"

_LONG = f"""
long_left AS (
  SELECT 'author' AS key_field, {_KEY.format('author')} AS key_value, level FROM comments
  UNION ALL SELECT 'submission_id', {_KEY.format('submission_id')}, level FROM comments
  UNION ALL SELECT 'subreddit', {_KEY.format('subreddit')}, level FROM comments),
long_right AS (
  SELECT 'author' AS key_field, {_KEY.format('author')} AS key_value FROM submissions
  UNION ALL SELECT 'submission_id', {_KEY.format('submission_id')} FROM submissions
  UNION ALL SELECT 'subreddit', {_KEY.format('subreddit')} FROM submissions),
l AS (SELECT key_field, key_value, count(*) AS left_rows, sum(level) AS left_level_sum FROM long_left WHERE key_value IS NOT NULL GROUP BY ALL),
r AS (SELECT key_field, key_value, count(*) AS right_rows FROM long_right WHERE key_value IS NOT NULL GROUP BY ALL),
j AS (
  SELECT key_field, key_value, left_rows, coalesce(right_rows, 0) AS right_rows, left_rows * coalesce(right_rows, 0) AS joined_rows,
         left_level_sum::BIGINT AS left_level_sum, (left_level_sum * coalesce(right_rows, 0))::BIGINT AS joined_left_level_sum
  FROM l LEFT JOIN r USING (key_field, key_value))
"""

_NODES = f"""
rec AS (
  SELECT {_ID.format('comment_id')} AS id, {_ID.format('parent_id')} AS p, level, created_utc, body,
         coalesce({_KEY.format('parent_id')} LIKE 't3\\_%' ESCAPE '\\', false) OR coalesce({_ID.format('parent_id')} = {_ID.format('submission_id')}, false) AS sub
  FROM comments),
node AS (
  SELECT id, max(p) AS p, coalesce(bool_or(sub) FILTER (p IS NOT NULL), false) AS sub, max(level) AS level, max(created_utc) AS t,
         bool_and(coalesce({_KEY.format('body')} IN ('[deleted]', '[removed]'), false)) AS gone
  FROM rec WHERE id IS NOT NULL GROUP BY id)
"""

SQL = {
    "p3_found": f"WITH {_LONG} SELECT key_field, key_value FROM l WHERE left_rows >= 0.02 * (SELECT count(*) FROM comments)",
    "p3_key_results": f"WITH {_LONG} SELECT key_field, key_value, left_rows, right_rows, joined_rows, left_level_sum, joined_left_level_sum FROM j",
    "p3_rollup": f"WITH {_LONG} SELECT key_field, count(*) AS keys, sum(left_rows)::BIGINT AS left_rows, sum(right_rows)::BIGINT AS right_rows, sum(joined_rows)::BIGINT AS joined_rows, max(left_rows) AS largest_key_rows FROM j GROUP BY key_field",
    "p4_found": f"""WITH RECURSIVE {_NODES},
walk(id, cur, steps) AS (
  SELECT id, id, 0 FROM node
  UNION
  SELECT w.id, n.p, w.steps + 1 FROM walk w JOIN node n ON n.id = w.cur
  JOIN node up ON up.id = n.p WHERE NOT n.sub AND w.steps < 2000 AND NOT (w.steps > 0 AND w.cur = w.id)),
cyc AS (SELECT DISTINCT id FROM walk WHERE steps > 0 AND cur = id),
into_cycle AS (SELECT DISTINCT w.id FROM walk w JOIN cyc ON w.cur = cyc.id),
far AS (SELECT w.id, max(w.steps) + 1 AS depth, max_by(n.sub, w.steps) AS ends FROM walk w JOIN node n ON n.id = w.cur WHERE w.id NOT IN (SELECT id FROM into_cycle) GROUP BY w.id)
SELECT id AS comment_id, 'cycle' AS finding FROM cyc
UNION ALL SELECT id, 'below_cycle' FROM into_cycle WHERE id NOT IN (SELECT id FROM cyc)
UNION ALL SELECT f.id, 'level_mismatch' FROM far f JOIN node n USING (id) WHERE f.ends AND n.level IS NOT NULL AND n.level <> f.depth""",
    "p5_found": f"""WITH {_NODES},
subs AS (SELECT {_ID.format('submission_id')} AS id, max(created_utc) AS t FROM submissions GROUP BY 1),
ref AS (SELECT id, p, t, CASE WHEN sub THEN 'submissions' ELSE 'comments' END AS ref_table, CASE WHEN t IS NULL THEN 'unknown' ELSE strftime(make_timestamp((floor(t) * 1000000)::BIGINT), '%Y-%m') END AS period FROM node WHERE p IS NOT NULL),
hit AS (
  SELECT ref.*, par.id IS NOT NULL AS here, coalesce(par.gone, false) AS gone, par.t AS pt FROM ref JOIN node par ON par.id = ref.p WHERE ref_table = 'comments'
  UNION ALL SELECT ref.*, false, false, NULL FROM ref WHERE ref_table = 'comments' AND p NOT IN (SELECT id FROM node)
  UNION ALL SELECT ref.*, subs.id IS NOT NULL, false, subs.t FROM ref LEFT JOIN subs ON subs.id = ref.p WHERE ref_table = 'submissions')
SELECT id AS comment_id, ref_table, 'missing' AS finding, period FROM hit WHERE NOT here
UNION ALL SELECT id, ref_table, 'deleted', period FROM hit WHERE gone
UNION ALL SELECT id, ref_table, 'late', period FROM hit WHERE pt > t""",
}
# Up to the top, a submission or a comment that was met before: every ancestor once.
_UP = f"""WITH RECURSIVE {_NODES},
up(id, cur, path, n) AS (
  SELECT id, id, [id], 0 FROM node
  UNION ALL
  SELECT u.id, p.id, list_prepend(p.id, u.path), u.n + 1 FROM up u JOIN node c ON c.id = u.cur JOIN node p ON p.id = c.p WHERE NOT c.sub AND NOT list_contains(u.path, p.id)),
far AS (SELECT id, max(n) AS n, max_by(path, n) AS path, max_by(cur, n) AS top FROM up GROUP BY id),
loops AS (SELECT f.id, t.p AS back FROM far f JOIN node t ON t.id = f.top WHERE NOT t.sub AND t.p IS NOT NULL AND list_contains(f.path, t.p)),
ring AS (SELECT id, back = id AS on_cycle FROM loops),
done AS (
  SELECT f.id AS comment_id, CASE WHEN NOT n.sub THEN n.p END AS parent_id, CASE WHEN r.on_cycle THEN 'cycle' WHEN r.id IS NOT NULL THEN 'below_cycle' WHEN t.sub THEN 'tree' ELSE 'open' END AS kind,
   CASE WHEN t.sub AND r.id IS NULL THEN (f.n + 1)::BIGINT END AS depth, CASE WHEN t.sub AND r.id IS NULL THEN t.p END AS root_submission, CASE WHEN r.id IS NULL THEN f.top END AS top_comment, CASE WHEN r.on_cycle THEN list_min(f.path) END AS cycle_id, n.level,
   CASE WHEN t.sub AND r.id IS NULL THEN list_prepend(t.p, f.path) ELSE f.path END AS path
  FROM far f JOIN node n ON n.id = f.id JOIN node t ON t.id = f.top LEFT JOIN ring r ON r.id = f.id)"""
SQL["p4_path_texts"] = f"{_UP}\nSELECT * REPLACE (array_to_string(path, '/') AS path) FROM done"
SQL["p4_descendants"] = f"{_UP}\nSELECT ancestor_id, comment_id AS descendant_id, (len(path) - k)::BIGINT AS distance FROM (SELECT comment_id, path, unnest(path) AS ancestor_id, generate_subscripts(path, 1) AS k FROM done) WHERE k < len(path)"
SQL["p5_report"] = f"SELECT ref_table, period, finding, count(*) AS comments FROM ({SQL['p5_found']}) GROUP BY ALL"
