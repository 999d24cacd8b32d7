"""Bootstrap, Bernoulli and network simulations; every draw is a function of seed and key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import safe_div
from threadloom.operators import metrics
from threadloom.operators.estimation import Design, nearest_psd
from threadloom.operators.history import before
from threadloom.runtime import Scratch, broadcast_if_small

#: Distinct scores in a slice of the bootstrap, slices of a group, scores of the sample that slices are cut by, and numbers that a block of replicates holds.
SLICE_CELLS, SLICES, CUT_SAMPLE, BLOCK = 8192, 1024, 200_000, 1 << 20


def bootstrap(df: DataFrame, replicates: int = 200, seed: int = 1, threshold: float = 0.5, y: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """[by,] replicate, average_precision, roc_auc, f1 of samples with replacement; one-class samples are left out.

    Every row gets, in every replicate, a Poisson(1) number of copies: the
    resample of a table of which no part has to know the size of the whole. No
    score is rounded and no row collected. A group's distinct scores are cut into slices;
    copies of the positives and of the other rows of a slice are Poisson numbers, drawn from the slices' counts, and
    given these the copies of its scores are multinomial, which makes every row's copies Poisson(1) again.
    So a slice is drawn once and alone, and knows what lies above it. Rows without a positive
    between two scores with one count only by their sum, so they are drawn as one cell.
    Draws are a function of seed, group, slice and the slices' counts, and slices of the scores: partitions and batches change nothing.
    """
    by = by or []
    scratch = Scratch(df.sparkSession, "bootstrap")
    rows = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("_score")).agg(F.count_if(F.col(y).cast("int") == 1).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    rows, seen = scratch.counted(rows.select(*by, F.xxhash64(*by, F.lit(seed)).alias("_g"), "_score", "_pos", (F.col("_n") - F.col("_pos")).alias("_neg"), (F.col("_score") >= threshold).alias("_hit")), n=F.lit(True))
    cells = rows.withColumn("_slice", _slices(rows, seen["n"]))
    key = ["_g", *by]
    per = cells.groupBy(*key, "_slice").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    # At most SLICES rows a group.
    per = per.withColumn("_all", F.array_sort(F.collect_list(F.struct("_slice", "_pos", "_neg")).over(Window.partitionBy(*key)))).select(*key, "_slice", *[F.col(f"_all.{c}").alias(f"{c}s") for c in ("_slice", "_pos", "_neg")])

    def dealt(rng: np.random.Generator, total: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Copies of each cell, a row a replicate, where ``total`` copies fall on rows of which cells have ``counts``."""
        out = np.zeros((len(total), len(counts)), np.int64)
        some = np.flatnonzero(counts)
        if len(some):
            out[:, some] = rng.multinomial(total, counts[some] / counts.sum())
        return out

    def draw(mine: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        mine, group = mine.sort_values("_score", ascending=False, na_position="first"), group.iloc[0]  # NaN is Spark's greatest number
        pos, neg, hit = (mine[c].to_numpy() for c in ("_pos", "_neg", "_hit"))
        first = np.flatnonzero(np.r_[True, (pos[1:] > 0) | (pos[:-1] > 0) | (hit[1:] != hit[:-1])])
        pos, neg, hit = np.add.reduceat(pos, first), np.add.reduceat(neg, first), hit[first]
        own, slices = [seed, int(group["_g"]) & 0xFFFFFFFFFFFFFFFF], np.asarray(group["_slices"])
        rng = np.random.default_rng([*own, 0])
        all_pos, all_neg = (rng.poisson(np.asarray(group[c], np.int64)[:, None], (len(slices), replicates)) for c in ("_poss", "_negs"))
        at, above, rng = slices == group["_slice"], slices > group["_slice"], np.random.default_rng([*own, int(group["_slice"]) + 1])
        at_pos, at_neg, over_pos, over_neg = all_pos[at][0], all_neg[at][0], all_pos[above].sum(0), all_neg[above].sum(0)
        all_pos, all_neg = all_pos.sum(0), all_neg.sum(0)
        sums, step = [], max(1, BLOCK // len(pos))
        for lo in range(0, replicates, step):
            r = slice(lo, lo + step)
            p, n = dealt(rng, at_pos[r], pos), dealt(rng, at_neg[r], neg)
            tp, fp = over_pos[r, None] + p.cumsum(1), over_neg[r, None] + n.cumsum(1)
            # Rank formula: each positive beats the negatives below it and half of those level with it.
            sums.append(np.stack([(p * tp / np.maximum(tp + fp, 1)).sum(1), (p * (all_neg[r, None] - fp + n / 2)).sum(1), p[:, hit].sum(1), n[:, hit].sum(1)]))
        ap, wins, tp, fp = np.concatenate(sums, 1)
        out = {c: [mine[c].iloc[0]] * replicates for c in by} | {"replicate": np.arange(replicates), "_slice": np.full(replicates, group["_slice"])}
        return pd.DataFrame(out | {"_ap": ap, "_wins": wins, "_tp": tp.astype(np.int64), "_fp": fp.astype(np.int64), "_pos": all_pos, "_neg": all_neg})

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    # Slices take long for their bytes: a given number of partitions, which adaptive execution doesn't join.
    parts = min(SLICES, 1 + seen["n"] // (SLICE_CELLS // 4))
    left, right = (t.repartition(parts, *key, "_slice").groupBy(*key, "_slice") for t in (cells, per))
    drawn = left.cogroup(right).applyInPandas(draw, f"{kinds}replicate bigint, _slice int, _ap double, _wins double, _tp bigint, _fp bigint, _pos bigint, _neg bigint")
    # Sums of fractions are taken in the slices' order: at most SLICES of a replicate.
    ap = F.aggregate(F.array_sort(F.collect_list(F.struct("_slice", "_ap"))), F.lit(0.0), lambda a, x: a + x["_ap"])
    total = drawn.groupBy(*by, "replicate").agg(ap.alias("_ap"), *[F.sum(c).alias(c) for c in ("_wins", "_tp", "_fp")], *[F.max(c).alias(c) for c in ("_pos", "_neg")]).filter((F.col("_pos") > 0) & (F.col("_neg") > 0))
    return total.select(*by, "replicate", (F.col("_ap") / F.col("_pos")).alias("average_precision"), (F.col("_wins") / (F.col("_pos").cast("double") * F.col("_neg"))).alias("roc_auc"), safe_div(2 * F.col("_tp"), F.col("_tp") + F.col("_fp") + F.col("_pos")).alias("f1"))


def _slices(cells: DataFrame, n: int) -> Column:
    """The slice that a score of a group lies in, rising with the score; bounds are scores of about equal distance in a sample by hash, the same at every run."""
    if n <= SLICE_CELLS:
        return F.lit(0)
    one_in = -(-n // CUT_SAMPLE)
    # About CUT_SAMPLE numbers are looked at, of which a group's bounds are at most SLICES - 1.
    part = cells.filter(F.pmod(F.xxhash64("_score", F.lit("cut")), F.lit(one_in)) == 0).groupBy("_g").agg(F.array_sort(F.collect_list("_score")).alias("_all"))
    step = F.greatest(F.lit(max(1, SLICE_CELLS // one_in)), F.ceil(F.size("_all") / SLICES).cast("int"))
    cut = part.filter(F.size("_all") > step).select("_g", F.transform(F.sequence(step, F.size("_all") - 1, step), lambda i: F.get("_all", i)).alias("_cuts"))
    bounds = {r["_g"]: np.array(r["_cuts"]) for r in cut.collect()}

    @F.pandas_udf("int")
    def find(g: pd.Series, score: pd.Series) -> pd.Series:
        out, g, score = np.zeros(len(g), np.int32), g.to_numpy(), score.to_numpy()
        for k in np.unique(g):
            if k in bounds:
                out[g == k] = np.searchsorted(bounds[k], score[g == k], side="right")
        return pd.Series(out)

    return find(F.col("_g"), F.col("_score"))


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on keys and seed only."""
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11).cast("double") / float(1 << 53)


def bernoulli_runs(instances: DataFrame, scenarios: dict[str, Column], runs: int, seed: int = 20260701, top: int = 10) -> DataFrame:
    """Per scenario and run: correcting instances, their rate, active threads, shares of cross-group and high-audience ones, share of the ``top`` threads.

    Instances (submission_id, author[, cross_group, high_audience], ...) draw one
    uniform number a run, the same in every scenario, so scenarios differ by their
    probabilities alone. Rows of a partition are summed per thread in arrays
    over the runs before anything is shuffled: a thread sends at most one row per
    scenario, partition and run in which anything of it corrects.
    """
    names = list(scenarios)
    flag = lambda c: (F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in instances.columns else F.lit(0)).alias(c)
    rows = instances.select("submission_id", F.xxhash64("submission_id", "author").alias("key"), flag("cross_group"), flag("high_audience"), *[F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)).alias(f"p{k}") for k, c in enumerate(scenarios.values())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                part = pdf.iloc[lo : lo + 4096]
                threads, code = np.unique(part["submission_id"].to_numpy(str), return_inverse=True)
                u = uniforms(part["key"].to_numpy(np.int64), runs, seed)
                cross, high = part["cross_group"].to_numpy(), part["high_audience"].to_numpy()
                for k, name in enumerate(names):
                    hit = u < part[f"p{k}"].to_numpy()[:, None]
                    sums = [np.zeros((len(threads), runs), np.int64) for _ in range(3)]
                    for total, weight in zip(sums, (np.ones(len(part), int), cross, high)):
                        np.add.at(total, code, hit * weight[:, None])
                    t, r = np.nonzero(sums[0])
                    yield pd.DataFrame({"submission_id": threads[t], "scenario": name, "run": r + 1, "c": sums[0][t, r], "x": sums[1][t, r], "h": sums[2][t, r]})

    hits = rows.mapInPandas(run, "submission_id string, scenario string, run bigint, c bigint, x bigint, h bigint")
    t = hits.groupBy("scenario", "run", "submission_id").agg(*[F.sum(c).alias(c) for c in "cxh"])
    # The top threads of a run: ranks are cut by their bound before they are shuffled.
    best = t.withColumn("_k", F.row_number().over(Window.partitionBy("scenario", "run").orderBy(F.desc("c"), "submission_id"))).filter(F.col("_k") <= top).groupBy("scenario", "run").agg(F.sum("c").alias("_top"))
    all_ = instances.agg(F.count(F.lit(1)).alias("instances"), F.count_distinct("submission_id").alias("threads"))
    grid = instances.sparkSession.range(1, runs + 1).select(F.col("id").alias("run"), F.explode(F.array(*[F.lit(n) for n in names])).alias("scenario"))
    g = t.groupBy("scenario", "run").agg(F.sum("c").alias("correcting"), F.count(F.lit(1)).alias("active_threads"), F.sum("x").alias("_x"), F.sum("h").alias("_h")).join(best, ["scenario", "run"])
    g = grid.join(F.broadcast(all_)).join(g, ["scenario", "run"], "left").fillna(0)  # one row
    return g.select("scenario", "run", "instances", "correcting", "threads", "active_threads", safe_div(F.col("correcting"), F.col("instances")).alias("rate"), safe_div(F.col("active_threads"), F.col("threads")).alias("activation"), safe_div(F.col("_x"), F.col("correcting")).alias("cross_group_share"), safe_div(F.col("_h"), F.col("correcting")).alias("high_audience_share"), safe_div(F.col("_top"), F.col("correcting")).alias("top_share"))


def uniforms(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Numbers in [0, 1), one row a key and one column a draw, that depend on key, draw and seed alone."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] + (np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed * 2 + 1))[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def summarise(draws: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Per ``by``: mean, sd, 2.5 and 97.5 % of each value."""
    return draws.groupBy(by).agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("low", lambda c: F.percentile(c, 0.025)), ("high", lambda c: F.percentile(c, 0.975)))])


def network_metrics(recs: DataFrame, reach: DataFrame) -> DataFrame:
    """One row: response rate, threads with a correction, comments after the first one, comments below one.

    reach: (ancestor_id, descendant_id) of the reply tree.
    """
    first = recs.filter(F.col("pred") == 1).groupBy("submission_id").agg(F.min("created_utc").alias("_first"))
    after = recs.join(first, "submission_id").agg(F.count_if(F.col("created_utc") > F.col("_first")).alias("comments_after"))
    below = reach.join(recs.filter(F.col("pred") == 1).select(F.col("comment_id").alias("ancestor_id")), "ancestor_id", "left_semi").join(recs.select(F.col("comment_id").alias("descendant_id")), "descendant_id", "left_semi").agg(F.count_distinct("descendant_id").alias("comments_below"))
    base = recs.agg(F.avg("pred").alias("response_rate"), F.count_distinct(F.when(F.col("pred") == 1, F.col("submission_id"))).alias("threads_with_correction"))
    return base.join(F.broadcast(after)).join(F.broadcast(below))  # one row each


#: Draws handled at once for a batch of records.
DRAWS = 100
NETWORK = ("rate", "thread_coverage", "comments_after", "same_branch_reach")


def network_draws(focal: DataFrame, comments: DataFrame, ancestors: DataFrame, designs: dict[str, tuple[Design, dict[str, Column]]], mixtures: dict[str, tuple[str, str, Column]], base: str, beta: np.ndarray, covariance: np.ndarray, draws: int, seed: int = 1) -> DataFrame:
    """draw, scenario and four network metrics under coefficients drawn from N(beta, covariance).

    focal: comment_id, submission_id, created_utc, outcome (0 or 1) and the
    covariates. comments: comment_id, submission_id, created_utc of all comments
    of the horizon. ancestors: (ancestor_id, descendant_id) of comments, the
    ancestor being focal. designs: name -> design and overrides of its
    columns; mixtures: scenario -> (design, alternative design, weight of the alternative per row).

    Within a draw all scenarios share a focal comment's latent rank, a uniform number
    conditioned on its observed outcome under ``base``. What a state needs to know
    of others is put into its row beforehand: how many comments come after it in its thread, how
    many lie below it, and the covariates of the focal comments above it. Then

    - a thread's comments after its first correction are the most that come after any correcting one,
    - a comment is reached by exactly one topmost correcting ancestor, so reach is the
      sum of what lies below correcting comments with no correcting one above,

    and a row's draws are sums and maxima in its own batch. Draws are a function of seed, draw and id.
    """
    spark = focal.sparkSession
    scratch = Scratch(spark, "network")
    safe, _ = nearest_psd(np.asarray(covariance, float))
    rng = np.random.default_rng(seed)
    values, vectors = np.linalg.eigh(safe)
    betas = np.asarray(beta, float) + rng.standard_normal((draws, len(beta))) @ (vectors * np.sqrt(np.maximum(values, 0))).T
    names, mixed = list(designs), list(mixtures)
    sides = [(a, b) for a, b, _ in mixtures.values()]
    x = focal.select("comment_id", "submission_id", "created_utc", F.col("outcome").cast("int").alias("outcome"), F.xxhash64("comment_id").alias("key"), F.array(*[w.cast("double") for _, _, w in mixtures.values()]).alias("weights"))
    for n, (design, overrides) in designs.items():
        part = focal.withColumns(overrides).filter(design.complete()).select("comment_id", design.vector().alias(f"x_{n}"))
        x = x.join(part, "comment_id")
    x = scratch.keep(x)
    # Comments after a focal one in its thread: ranks over thread and time, focal rows before comments of their second.
    after = before(x.select("submission_id", "comment_id", (-F.col("created_utc")).alias("_at")), comments.select("submission_id", (-F.col("created_utc")).alias("_time")), "submission_id", "_at", "_time", {"after": F.lit(1)}, comments)
    own = x.select(F.col("comment_id").alias("ancestor_id"))
    reach = scratch.keep(ancestors.join(broadcast_if_small(own), "ancestor_id", "left_semi").join(comments.select(F.col("comment_id").alias("descendant_id")), "descendant_id", "left_semi"))
    below = reach.groupBy(F.col("ancestor_id").alias("comment_id")).agg(F.count(F.lit(1)).alias("below"))
    state = [c for c in x.columns if c not in ("submission_id", "created_utc", "comment_id")]
    up = reach.join(x.select(F.col("comment_id").alias("ancestor_id"), F.struct(*state).alias("s")), "ancestor_id").join(own.withColumnRenamed("ancestor_id", "descendant_id"), "descendant_id", "left_semi")
    up = up.groupBy(F.col("descendant_id").alias("comment_id")).agg(F.collect_list("s").alias("above"))  # as many as a path is long
    full = x.join(after.select("comment_id", F.col("after").cast("bigint").alias("after")), "comment_id").join(below, "comment_id", "left").join(up, "comment_id", "left").fillna(0, ["below"])
    full = scratch.keep(full)
    shared = spark.sparkContext.broadcast(betas)

    def states(rows: pd.DataFrame, lo: int, hi: int) -> np.ndarray:
        """scenario x row x draw."""
        b = shared.value[lo:hi]
        p = {n: 1 / (1 + np.exp(-np.clip(np.stack(rows[f"x_{n}"].to_numpy()) @ b.T, -35, 35))) for n in names}
        u = uniforms(rows["key"].to_numpy(np.int64), draws, seed)[:, lo:hi]
        w = np.stack(rows["weights"].to_numpy())
        seen = rows["outcome"].to_numpy()[:, None] == 1
        rank = np.where(seen, u * p[base], p[base] + u * (1 - p[base]))
        return np.stack([rank < (1 - w[:, [k]]) * p[one] + w[:, [k]] * p[other] for k, (one, other) in enumerate(sides)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 1024):
                rows = pdf.iloc[a : a + 1024].reset_index(drop=True)
                threads, code = np.unique(rows["submission_id"].to_numpy(str), return_inverse=True)
                lists = [list(v) if v is not None else [] for v in rows["above"]]
                owner = np.repeat(np.arange(len(rows)), [len(v) for v in lists])
                over = pd.DataFrame([dict(r.asDict() if hasattr(r, "asDict") else r) for v in lists for r in v])
                for lo in range(0, draws, DRAWS):
                    hi = min(draws, lo + DRAWS)
                    on = states(rows, lo, hi)
                    free = np.ones_like(on)
                    if len(over):
                        covered = states(over, lo, hi)
                        for k in range(len(mixed)):
                            hidden = np.zeros(on.shape[1:], int)
                            np.add.at(hidden, owner, covered[k])
                            free[k] = hidden == 0
                    for k, name in enumerate(mixed):
                        n, most, reached = (np.zeros((len(threads), hi - lo), np.int64) for _ in range(3))
                        np.add.at(n, code, on[k])
                        np.maximum.at(most, code, on[k] * rows["after"].to_numpy()[:, None])
                        np.add.at(reached, code, on[k] * free[k] * rows["below"].to_numpy()[:, None])
                        t, d = np.nonzero(n)
                        yield pd.DataFrame({"submission_id": threads[t], "scenario": name, "draw": d + lo, "n": n[t, d], "after": most[t, d], "reached": reached[t, d]})

    hits = full.mapInPandas(run, "submission_id string, scenario string, draw bigint, n bigint, after bigint, reached bigint")
    t = hits.groupBy("scenario", "draw", "submission_id").agg(F.sum("n").alias("n"), F.max("after").alias("after"), F.sum("reached").alias("reached"))
    g = t.groupBy("scenario", "draw").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_t"), F.sum("after").alias("_a"), F.sum("reached").alias("_r"))
    size = full.agg(F.count(F.lit(1)).alias("_focal"), F.count_distinct("submission_id").alias("_threads")).join(F.broadcast(comments.agg(F.count(F.lit(1)).alias("_comments"))))  # one row each
    grid = spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.array(*[F.lit(n) for n in mixed])).alias("scenario"))
    g = grid.join(F.broadcast(size)).join(g, ["scenario", "draw"], "left").fillna(0)
    return g.select("draw", "scenario", *[safe_div(F.col(a), F.col(b)).alias(n) for n, (a, b) in zip(NETWORK, (("_n", "_focal"), ("_t", "_threads"), ("_a", "_comments"), ("_r", "_comments")))])


def against_baseline(draws: DataFrame, values: list[str], baseline: str = "baseline") -> DataFrame:
    """Per scenario and metric: mean and 95 % interval, and those of the difference from the baseline of the same draw."""
    long = draws.select("draw", "scenario", F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).alias("v")) for v in values])).alias("_x")).select("draw", "scenario", "_x.*")
    own = long.filter(F.col("scenario") == baseline).select("draw", "metric", F.col("v").alias("_b"))
    d = long.join(own, ["draw", "metric"]).withColumn("_d", F.col("v") - F.col("_b"))
    return d.groupBy("scenario", "metric").agg(F.avg("v").alias("estimate"), F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"), F.avg("_d").alias("difference"), F.percentile("_d", 0.025).alias("difference_low"), F.percentile("_d", 0.975).alias("difference_high"))
