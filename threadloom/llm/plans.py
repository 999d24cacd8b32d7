"""Queries of the text operators, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import abuse, leakage, mixture, pii, splits, stuffing
from threadloom.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return abuse.abusive(abuse.score_comments(table(spark, root, "comments"), table(spark, root, "comment_labels"), locate=False))


def p1_rates(spark: SparkSession, root: str) -> DataFrame:
    return abuse.rates(abuse.score_comments(table(spark, root, "comments"), table(spark, root, "comment_labels"), locate=False))


def p1_sentences(spark: SparkSession, root: str) -> DataFrame:
    """The comments to review with the sentence that offends most."""
    scored = abuse.score_comments(table(spark, root, "comments"), table(spark, root, "comment_labels"))
    return scored.filter(F.col("score") > abuse.THRESHOLD)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return pii.found(pii.find_details(table(spark, root, "comments")))


def p2_redacted(spark: SparkSession, root: str) -> DataFrame:
    comments = table(spark, root, "comments")
    return pii.redact(comments, pii.find_details(comments))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Tied pairs by the component table, which two batches of arrivals build."""
    return splits.tied_groups(splits.arrivals(table(spark, root, "candidate_pairs")), table(spark, root, "split_targets"))


def _split(spark: SparkSession, root: str) -> splits.SplitResult:
    records, links = splits.pair_links(table(spark, root, "candidate_pairs"))
    return splits.assign(records, links, table(spark, root, "split_targets"))


def p6_splits(spark: SparkSession, root: str) -> DataFrame:
    return _split(spark, root).records.select(F.col("record").alias("pair_id"), F.col("component").alias("group_id"), "split")


def p6_shares(spark: SparkSession, root: str) -> DataFrame:
    return splits.share_report(_split(spark, root), table(spark, root, "split_targets"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return leakage.find_leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p7_items(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leak_report(p7_found(spark, root), table(spark, root, "eval_items"))


def p8_mixture(spark: SparkSession, root: str) -> DataFrame:
    return mixture.mix(table(spark, root, "documents"), table(spark, root, "source_targets"))


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixture.shares(p8_mixture(spark, root), table(spark, root, "source_targets"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return stuffing.stuffed(table(spark, root, "documents"))


def p9_scores(spark: SparkSession, root: str) -> DataFrame:
    return stuffing.score_pages(table(spark, root, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p1_sentences, p2_found, p2_redacted, p6_found, p6_splits, p6_shares, p7_found, p7_items, p8_mixture, p8_shares, p9_found, p9_scores)}

_ID = "nullif(regexp_replace(lower(trim({})), '^t[13]_', ''), '')"
_WHO = "CASE WHEN lower(trim({0})) NOT IN ('', '[deleted]', 'automoderator') THEN 'a:' || lower(trim({0})) END"

SQL = {
    "p6_found": f"""WITH RECURSIVE link AS (
  SELECT DISTINCT {_ID.format('pair_id')} AS r, unnest([
    's:' || {_ID.format('submission_id')}, 'r:' || {_ID.format('response_id')}, {_WHO.format('claim_author')}, {_WHO.format('response_author')}]) AS e
  FROM candidate_pairs),
good AS (SELECT r, e FROM link WHERE r IS NOT NULL AND e IS NOT NULL),
edge AS (SELECT DISTINCT a.r AS x, b.r AS y FROM good a JOIN good b USING (e) WHERE a.r <> b.r),
reach(x, y) AS (SELECT x, y FROM edge UNION SELECT reach.x, edge.y FROM reach JOIN edge ON edge.x = reach.y)
SELECT x AS pair_id, least(x, min(y)) AS group_id FROM reach GROUP BY x""",
}
