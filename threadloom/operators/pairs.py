"""Claim-response pairs: nearest claims, candidates, reduction to comments, parent context, query matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.keys import plain_id
from threadloom.functions.lexicon import first_matching_query, query_terms
from threadloom.functions.text import pair_id
from threadloom.operators.records import in_order
from threadloom.runtime import BROADCAST_BYTES, cut_hot, estimated_bytes

#: Characters of the index entries of queries that are too many to be broadcast.
PIECE = 3


def nearest_prior_claim(recs: DataFrame, is_claim: F.Column) -> DataFrame:
    """comment_id, claim_id: the last earlier comment of the thread that is a claim, null if none.

    A window per thread; a thread with many of the rows is cut into slices, and
    where a slice has none before a row, the last claim of the slices before it
    counts, from one row a slice. Give a written table.
    """
    r = recs.select("submission_id", "comment_id", "created_utc", F.when(is_claim, F.col("comment_id")).alias("_claim"))
    r, several = cut_hot(r, "submission_id", ["created_utc", "comment_id"], recs)
    w = Window.partitionBy("submission_id", "_slice").orderBy("created_utc", "comment_id").rowsBetween(Window.unboundedPreceding, -1)
    inner = r.withColumn("_in", F.last("_claim", ignorenulls=True).over(w))
    if not several:
        return inner.select("submission_id", "comment_id", F.col("_in").alias("claim_id"))
    last = F.max(F.when(F.col("_claim").isNotNull(), F.struct("created_utc", "comment_id")))
    per = r.groupBy("submission_id", "_slice").agg(last.alias("_last"))
    back = Window.partitionBy("submission_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("submission_id", "_slice", F.last("_last.comment_id", ignorenulls=True).over(back).alias("_before"))
    return inner.join(per, ["submission_id", "_slice"]).select("submission_id", "comment_id", F.coalesce("_in", "_before").alias("claim_id"))


def parent_context(recs: DataFrame) -> DataFrame:
    """comment_id with parent author, correction flag and body; empty and 0 where there is no parent."""
    p = recs.select(F.col("comment_id").alias("parent_id"), F.col("author").alias("parent_author"), F.col("pred").alias("parent_pred"), F.col("body").alias("parent_body"))
    j = recs.select("comment_id", "parent_id").join(p, "parent_id", "left")
    return j.select("comment_id", F.coalesce("parent_author", F.lit("")).alias("parent_author"), F.coalesce("parent_pred", F.lit(0)).alias("parent_pred"), F.coalesce("parent_body", F.lit("")).alias("parent_body"))


def candidate_pairs(recs: DataFrame, is_claim: F.Column, seen: DataFrame | None = None) -> DataFrame:
    """pair_id, claim_id, response_id, source, gap: up to two pairs per candidate response.

    The parent comment if it is in the table, else the title; besides, the
    nearest earlier claim where it is another comment. ``seen`` (pair_id) are left
    out. A pair that arises twice is kept once.
    """
    r = in_order(recs)
    resp = r.filter((F.col("candidate") == 1) & F.col("author").isNotNull())
    par = recs.select(F.col("comment_id").alias("parent_id"), F.col("created_utc").alias("parent_time"), F.lit(True).alias("_in"))
    j = resp.join(par, "parent_id", "left")
    first = j.select("comment_id", F.when(F.col("_in"), F.col("parent_id")).otherwise(F.concat(F.lit("submission:"), F.col("submission_id"))).alias("claim_id"), F.when(F.col("_in"), "parent").otherwise("title").alias("source"), (F.col("created_utc") - F.col("parent_time")).alias("gap"))
    near = nearest_prior_claim(recs, is_claim).filter(F.col("claim_id").isNotNull())
    times = recs.select(F.col("comment_id").alias("claim_id"), F.col("created_utc").alias("claim_time"))
    second = resp.join(near.select("comment_id", "claim_id"), "comment_id").filter(~F.col("claim_id").eqNullSafe(F.col("parent_id"))).join(times, "claim_id").select("comment_id", "claim_id", F.lit("nearest").alias("source"), (F.col("created_utc") - F.col("claim_time")).alias("gap"))
    out = first.unionByName(second).select(pair_id(F.col("claim_id"), F.col("comment_id"), F.col("source")).alias("pair_id"), "claim_id", F.col("comment_id").alias("response_id"), "source", "gap")
    out = out.dropDuplicates(["pair_id"])
    return out if seen is None else out.join(seen.select("pair_id").distinct(), "pair_id", "left_anti")


def reduce_to_comments(pairs: DataFrame, score: str = "public_correction_score") -> DataFrame:
    """Per response: the best score, the number of pairs and the best pair (smallest id among equals)."""
    p = pairs.select(plain_id(F.col("response_id")).alias("comment_id"), plain_id(F.col("pair_id")).alias("pair_id"), F.coalesce(F.col(score), F.lit(0.0)).alias("s")).filter(F.col("comment_id").isNotNull() & F.col("pair_id").isNotNull())
    p = p.groupBy("comment_id", "pair_id").agg(F.max("s").alias("s"))
    return p.groupBy("comment_id").agg(F.max("s").alias("score"), F.count(F.lit(1)).alias("pairs"), F.min_by("pair_id", F.struct(-F.col("s"), F.col("pair_id"))).alias("best_pair"))


def claim_matches(posts: DataFrame, claims: DataFrame, text: str, key: str, per_claim: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Posts that match a claim by any of its queries, with the first matching query.

    Claims of at most ``BROADCAST_BYTES`` become one array in a broadcast row, and a post is
    tested against all of them where it lies. Beyond that each query is
    entered in an index under the first characters of its longest term, and
    posts look up the pieces of their texts: work then grows with the matches and not with
    posts x claims. ``per_claim`` keeps the first so many posts of each claim by key.
    A null text or a claim without queries matches nothing.
    """
    if estimated_bytes(claims) <= limit:
        array = claims.select(F.collect_list(F.struct("claim_id", "queries")).alias("_claims"))  # within the limit
        hit = posts.select(key, F.col(text).alias("_text")).join(F.broadcast(array)).select(key, "_text", F.explode("_claims").alias("_c"))
        m = hit.select(F.col("_c.claim_id").alias("claim_id"), key, first_matching_query(F.col("_text"), F.col("_c.queries")).alias("query")).filter(F.col("query").isNotNull())
    else:
        q = claims.select("claim_id", F.posexplode("queries").alias("_pos", "query")).withColumn("_terms", query_terms(F.col("query"))).filter(F.size("_terms") > 0)
        longest = F.array_max(F.transform("_terms", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
        index = q.select("claim_id", "_pos", "query", F.substring(longest, 1, PIECE).alias("_piece"))
        low = F.lower(F.coalesce(F.col(text), F.lit("")))
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.length(low) > 0)
        pieces = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(*[F.substring(low, i, F.lit(n)) for n in range(1, PIECE + 1)]))))
        near = posts.select(key, F.col(text).alias("_text"), F.explode(pieces).alias("_piece")).join(index, "_piece")
        near = near.filter(first_matching_query(F.col("_text"), F.array("query")).isNotNull())
        m = near.groupBy("claim_id", key).agg(F.min_by("query", "_pos").alias("query"))
    if per_claim is None:
        return m
    w = Window.partitionBy("claim_id").orderBy(key)
    return m.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= per_claim).drop("_k")


def membership(frame: DataFrame, known: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Adds seen_<name> per key: whether the value occurs in ``known`` (null never does)."""
    out = frame
    for name, col in keys.items():
        side = known.select(F.col(col).alias(col)).filter(F.col(col).isNotNull()).distinct().withColumn(f"seen_{name}", F.lit(1))
        out = out.join(side, col, "left").withColumn(f"seen_{name}", F.coalesce(f"seen_{name}", F.lit(0)))
    return out
