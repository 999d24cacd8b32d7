"""Exact classifier metrics with ties, as aggregates and windows over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import safe_div


#: Slices of [min, max] that distinct scores are cut into: windows run within one, sums of them carry the rest.
SLICES = 1024


def curve(df: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Per distinct score: positives and rows at it and above it (tp, n_above), precision, recall.

    Rows (or their ``weight``) are first summed per distinct score. The order of
    scores is then taken in two levels: windows within slices of the range of scores,
    and running sums of the slices' totals, at most ``SLICES`` a group. No window
    holds all scores, however many differ.
    """
    by = by or []
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    g = df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("pos"), F.sum(w).alias("n"))
    # The number of a score's slice is a rising function of the score: scores are compared, never rounded.
    g = g.withColumn("_slice", F.floor(F.atan(F.col(score) * 4 - 2) * (SLICES / 3.2)).cast("int"))
    per = g.groupBy(*by, "_slice").agg(F.sum("pos").alias("_pos"), F.sum("n").alias("_n"))
    back = Window.partitionBy(*by).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*by)
    per = per.select(*by, "_slice", *[F.coalesce(F.sum(c).over(back), F.lit(0)).alias(f"{c}_before") for c in ("_pos", "_n")], F.sum("_pos").over(all_).alias("total_pos"), F.sum("_n").over(all_).alias("total"))
    inner = Window.partitionBy(*by, "_slice").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = g.withColumns({"_tp": F.sum("pos").over(inner), "_above": F.sum("n").over(inner)}).join(per, [*by, "_slice"])
    c = c.select(*by, score, "pos", "n", (F.col("_tp") + F.col("_pos_before")).alias("tp"), (F.col("_above") + F.col("_n_before")).alias("n_above"), "total_pos", "total")
    return c.withColumns({"precision": safe_div(F.col("tp"), F.col("n_above")), "recall": safe_div(F.col("tp"), F.col("total_pos"))})


def ranking(df: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """n, positives, average_precision and roc_auc (null with one class only)."""
    by = by or []
    c = curve(df, y, score, by, weight)
    # Rank formula: each positive beats the negatives below it and half of those level with it.
    neg_at, neg_below = F.col("n") - F.col("pos"), (F.col("total") - F.col("total_pos")) - (F.col("n_above") - F.col("tp"))
    wins = F.sum(F.col("pos") * (neg_below + neg_at / 2))
    cells = F.max("total_pos") * (F.max("total") - F.max("total_pos"))
    return c.groupBy(*by).agg(F.max("total").alias("n"), F.max("total_pos").alias("positives"), safe_div(F.sum(F.col("pos") * F.col("precision")), F.max("total_pos")).alias("average_precision"), F.try_divide(wins, cells.cast("double")).alias("roc_auc"))


def threshold_metrics(df: DataFrame, threshold: float | Column, y: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """n, confusion, precision, recall, f1, brier at a threshold; zero denominators give 0."""
    by = by or []
    hit, pos = F.col(score) >= threshold, F.col(y) == 1
    m = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"), F.avg(F.pow(F.col(score) - F.col(y), 2)).alias("brier"),
    )
    m = m.withColumns({"prevalence": safe_div(F.col("tp") + F.col("fn"), F.col("n")), "precision": safe_div(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe_div(F.col("tp"), F.col("tp") + F.col("fn"))})
    return m.withColumn("f1", safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def sweep(df: DataFrame, thresholds: list[float], y: str = "y", score: str = "score") -> DataFrame:
    """Metrics per threshold, in one pass over the rows."""
    long = df.select(y, score, F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    return threshold_metrics(long, F.col("threshold"), y, score, ["threshold"])


def best_threshold(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """The score at which (f1, precision, recall) is greatest."""
    c = curve(df, y, score).withColumn("f1", safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return c.agg(F.max_by(F.struct(F.col(score).alias("threshold"), "f1", "precision", "recall"), F.struct("f1", "precision", "recall", F.col(score))).alias("_b")).select("_b.*")


def calibration(df: DataFrame, bins: int = 10, y: str = "y", score: str = "score") -> DataFrame:
    """Equal-width, right-closed bins (0 in the first): n, mean score, rate, gap; empty bins are left out."""
    b = F.greatest(F.ceil(F.col(score) * bins), F.lit(1)).cast("int")
    g = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(y).alias("rate"))
    total = F.sum("n").over(Window.partitionBy())
    return g.withColumn("gap", F.abs(F.col("mean_score") - F.col("rate"))).withColumn("ece_part", F.col("gap") * F.col("n") / total)


def subgroups(df: DataFrame, dims: dict[str, Column], threshold: float, least: int = 30, y: str = "y", score: str = "score") -> DataFrame:
    """Threshold metrics and rankings per (dimension, subgroup) with enough rows and both classes."""
    long = df.select(y, score, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("subgroup")) for d, c in dims.items()])).alias("_g")).select(y, score, "_g.*")
    key = ["dimension", "subgroup"]
    m = threshold_metrics(long, threshold, y, score, key).join(ranking(long, y, score, key).select(*key, "average_precision", "roc_auc"), key)
    return m.filter((F.col("n") >= least) & (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0))


def benjamini_hochberg(df: DataFrame, p: str = "p", key: str = "term") -> DataFrame:
    """Adds q: p n / rank, made monotone from the largest p down, at most 1. For tables of tests, not of rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(p, key))
    raw = df.withColumn("_rank", rank).withColumn("_raw", F.col(p) * n / F.col("_rank"))
    low = F.min("_raw").over(Window.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return raw.withColumn("q", F.least(low, F.lit(1.0))).drop("_rank", "_raw")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, n, mean, sd (sample), min, quartiles (linear), max."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_x")).select("_x.*").filter(F.col("v").isNotNull())
    return long.groupBy("variable").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), F.percentile("v", 0.25).alias("q1"), F.percentile("v", 0.5).alias("median"), F.percentile("v", 0.75).alias("q3"), F.max("v").alias("max"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for all pairs in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("_x")).select("_x.*")


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <c>_z by population mean and deviation; a deviation of 0 or none counts as 1."""
    sd = lambda c: F.coalesce(F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)), F.lit(1.0))
    m = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[sd(c).alias(f"_s_{c}") for c in columns])
    z = df.join(F.broadcast(m))  # one row
    return z.select(*df.columns, *[((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(f"{c}_z") for c in columns])


def compare(df: DataFrame, scores: dict[str, Column], threshold: float = 0.5, y: str = "y") -> DataFrame:
    """Per model (name -> score): threshold metrics, average precision and ROC AUC on the same rows."""
    long = df.select(F.col(y).alias("_y"), F.explode(F.array(*[F.struct(F.lit(n).alias("model"), c.cast("double").alias("_score")) for n, c in scores.items()])).alias("_m")).select("_y", "_m.*").filter(F.col("_score").isNotNull())
    return threshold_metrics(long, threshold, "_y", "_score", ["model"]).join(ranking(long, "_y", "_score", ["model"]).select("model", "average_precision", "roc_auc"), "model")


def class_metrics(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """Per class: true and predicted rows, hits (right ones), precision, recall; and the accuracy over all in every row."""
    classes = df.filter(F.col(y).isNotNull() & F.col(predicted).isNotNull()).select(F.explode(F.array(F.struct(F.col(y).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(y) == F.col(predicted)).cast("int").alias("b")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("b")))).alias("_x")).select("_x.*")
    g = classes.groupBy("label").agg(F.sum("t").alias("rows"), F.sum("p").alias("predicted"), F.sum("b").alias("hits"))
    all_ = Window.partitionBy()  # one row a class
    return g.withColumns({"precision": safe_div(F.col("hits"), F.col("predicted")), "recall": safe_div(F.col("hits"), F.col("rows")), "accuracy": safe_div(F.sum("hits").over(all_), F.sum("rows").over(all_))})


def recalibration(df: DataFrame, y: str = "y", score: str = "score") -> dict[str, float]:
    """intercept and slope of a logit of the outcome on the score's log odds (scores kept off 0 and 1 by 1e-6)."""
    from threadloom.operators import estimation

    p = F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
    fit = estimation.fit_logit(df.select(F.col(y).alias("_y"), F.ln(p / (1 - p)).alias("log_odds")), estimation.Design(["log_odds"]), "_y")
    return {"intercept": float(fit.beta[0]), "slope": float(fit.beta[1]), "converged": fit.converged}


def quartile_names(df: DataFrame, column: str, names: tuple[str, ...] = ("shortest", "short", "long", "longest")) -> Column:
    """The quarter of the rows that a value lies in: right-closed between exact linear quantiles; equal bounds make one quarter."""
    cut = df.agg(*[F.percentile(column, k / len(names)).alias(f"q{k}") for k in range(1, len(names))]).first()
    bounds = sorted({cut[f"q{k}"] for k in range(1, len(names)) if cut[f"q{k}"] is not None})
    case = None
    for name, b in zip(names, bounds):
        case = (F.when if case is None else case.when)(F.col(column) <= b, name)
    return F.when(F.col(column).isNull(), None).otherwise(F.lit(names[0]) if case is None else case.otherwise(names[len(bounds)]))
