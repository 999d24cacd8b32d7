"""Deterministic samples and splits: rows are ordered by a digest of key and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import sequence_id
from threadloom.runtime import Scratch, broadcast_if_small


def shuffle_key(key: str, seed: int) -> Column:
    """A digest that any engine can repeat; the order of a sample."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def simple(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.withColumn("_s", shuffle_key(key, seed)).orderBy("_s", key).limit(n).drop("_s")


def stratified(df: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """Up to n rows of every stratum."""
    w = Window.partitionBy(*strata).orderBy(shuffle_key(key, seed), key)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def ranked_in(df: DataFrame, groups: list[str], order: str, key: str) -> DataFrame:
    """Adds ``_rank`` (from 1 within the groups by ``order``, a hexadecimal digest, then key) and ``_total``.

    Two levels: windows within 4,096 slices of the digests, and running counts of the
    slices. Two labels thus make thousands of tasks, not two.
    """
    d = df.withColumn("_slice", F.substring(order, 1, 3))
    per = d.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    all_ = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_n").over(all_.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_slice").alias("_s"), before.alias("_before"), F.sum("_n").over(all_).alias("_total"))
    inner = F.row_number().over(Window.partitionBy(*groups, "_slice").orderBy(order, key))
    same = F.col("_slice") == F.col("_s")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    r = d.withColumn("_k", inner).join(broadcast_if_small(per), same)
    return r.select(*[c for c in d.columns if c != "_slice"], (F.col("_k") + F.col("_before")).alias("_rank"), "_total")


def stratified_fill(df: DataFrame, strata: list[str], key: str, per_stratum: int, total: int, score: str, seed: int, centre: float = 0.5) -> DataFrame:
    """``per_stratum`` rows of each stratum, filled up to ``total`` with the rows nearest to ``centre``; ``total`` bounds all."""
    ranked = ranked_in(df.withColumn("_s5", shuffle_key(key, seed)), strata, "_s5", key).withColumn("_fill", (F.col("_rank") > per_stratum).cast("int"))
    order = [F.col("_fill"), F.when(F.col("_fill") == 1, F.abs(F.col(score) - centre)).otherwise(0.0), F.col("_s5"), F.col(key)]
    return ranked.orderBy(*order).limit(total).withColumn("phase", F.when(F.col("_fill") == 1, "fill").otherwise("stratum")).select(*df.columns, "phase")


def parse_quotas(value: str) -> dict[str, int]:
    """``name=number,name=number`` in order; blanks around parts are ignored."""
    pairs = (part.partition("=") for part in value.split(",") if part.strip())
    return {name.strip(): int(number) for name, _, number in pairs}


def components(df: DataFrame, pools: dict[str, tuple[Column, int, list[Column]]], key: str, target: int = 0, fallback: tuple[str, list[Column]] | None = None) -> DataFrame:
    """Ordered components: each takes its quota in its own order from rows no earlier one took; then ``fallback`` up to ``target``.

    Keys are unique, and ``df`` is a written table; every component's rows, as many as its quota, are written
    before the next one is chosen, so plans do not grow with the components.
    """
    scratch = Scratch(df.sparkSession, "components")
    taken, n = None, 0
    for name, (cond, quota_, order) in [*pools.items(), *([(fallback[0], (F.lit(True), None, fallback[1]))] if fallback else [])]:
        size = max(0, target - n) if quota_ is None else quota_
        left = df if taken is None else df.join(F.broadcast(taken.select(key)), key, "left_anti")  # no more than the quotas
        part, seen = scratch.counted(left.filter(F.coalesce(cond, F.lit(False))).orderBy(*order, key).limit(size).withColumn("component", F.lit(name)), n=F.lit(True))
        taken, n = part if taken is None else taken.unionByName(part), n + seen["n"]
    return taken


def quota(df: DataFrame, pools: dict[str, tuple[Column, int]], key: str, priority: Column) -> DataFrame:
    """Ordered components: each takes its quota from its pool, by priority, from rows not taken before."""
    return components(df, {name: (cond, n, [priority.desc()]) for name, (cond, n) in pools.items()}, key)


def greedy(df: DataFrame, pools: dict[str, tuple[Column, int]], key: str, caps: dict[str, int], order: list[Column], target: int = 0) -> DataFrame:
    """Ordered components under caps per group, then a fill from all rows up to ``target``; adds taken_as and place.

    ``caps``: column -> most rows of one value over all components, the finer group first (a response lies
    in one thread). Accepting row by row in priority order is the same as cutting
    to what each finer group has left, then to what each coarser one has left, then to the
    quota: once a coarser group is full, none of its later rows counts for a finer one.
    Ranks are cut by the cap before they are shuffled, so a hot group sends a cap of rows a task.
    """
    scratch = Scratch(df.sparkSession, "greedy")
    taken, n = None, 0
    for name, (cond, quota_) in [*pools.items(), *([("fill", (F.lit(True), None))] if target else [])]:
        size = max(0, target - n) if quota_ is None else quota_
        left = df.filter(F.coalesce(cond, F.lit(False)))
        if taken is not None:
            left = left.join(F.broadcast(taken.select(key)), key, "left_anti")  # no more than the quotas
        for group, cap in caps.items():
            g = F.coalesce(F.col(group), F.lit(""))
            ranked = left.withColumn("_g", g).withColumn("_k", F.row_number().over(Window.partitionBy("_g").orderBy(*order, key))).filter(F.col("_k") <= cap)
            if taken is not None:
                used = taken.groupBy(g.alias("_g")).agg(F.count(F.lit(1)).alias("_used"))
                ranked = ranked.join(F.broadcast(used), "_g", "left").filter(F.col("_k") + F.coalesce("_used", F.lit(0)) <= cap).drop("_used")  # no more than the quotas
            left = ranked.drop("_g", "_k")
        part = left.orderBy(*order, key).limit(size)
        place = F.row_number().over(Window.orderBy(*order, key)) + n  # of at most the quota's rows
        part, seen = scratch.counted(part.withColumns({"taken_as": F.lit(name), "place": place.cast("bigint")}), n=F.lit(True))
        taken, n = part if taken is None else taken.unionByName(part), n + seen["n"]
    return taken


def quota_capped(df: DataFrame, pools: dict[str, tuple[Column, int]], key: str, group: str, cap: int, priority: Column) -> DataFrame:
    """As ``quota``, with at most ``cap`` rows of a group over all components."""
    return greedy(df, pools, key, {group: cap}, [priority.desc()]).withColumnRenamed("taken_as", "component").drop("place")


def flag_balanced(df: DataFrame, flag: str, targets: dict[int, int], strata: list[str], per_stratum: int, key: str, order: str, total: int) -> DataFrame:
    """Rows up to a target per value of ``flag``: first at most ``per_stratum`` of each stratum, then others of the flag, then any up to ``total``; adds phase."""
    goal = F.lit(0)
    for value, n in targets.items():
        goal = F.when(F.col(flag) == value, n).otherwise(goal)
    scratch = Scratch(df.sparkSession, "balanced")
    rank = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(order, key))  # noqa: E731  (cut by its filter before the shuffle)
    first = df.withColumn("_k", rank([flag, *strata])).filter(F.col("_k") <= per_stratum).withColumn("_k", rank([flag])).filter(F.col("_k") <= goal)
    first = scratch.keep(first.select(*df.columns, F.lit("stratum").alias("phase")))
    most = max(targets.values())
    held = first.groupBy(flag).agg(F.count(F.lit(1)).alias("_held"))
    rest = df.join(F.broadcast(first.select(key)), key, "left_anti").withColumn("_k", rank([flag])).filter(F.col("_k") <= most).join(F.broadcast(held), flag, "left")
    second = scratch.keep(rest.filter(F.col("_k") + F.coalesce("_held", F.lit(0)) <= goal).select(*df.columns, F.lit("flag").alias("phase")))
    taken = first.unionByName(second)
    n = taken.count()
    third = df.join(F.broadcast(taken.select(key)), key, "left_anti").orderBy(order, key).limit(max(0, total - n)).select(*df.columns, F.lit("fill").alias("phase"))
    return taken.unionByName(third)


def annotation_sheet(taken: DataFrame, prefix: str, fields: list[str]) -> DataFrame:
    """A chosen sample with sequence ids in its order (``place``) and empty fields to be filled in."""
    return taken.select("*", sequence_id(prefix, F.col("place")).alias("annotation_id"), *[F.lit("").alias(f) for f in fields])


def tagged(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Rows with any reason: reasons (joined by a bar, in order), primary_reason (the first), n_reasons."""
    all_ = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in reasons.items()]))
    out = df.withColumn("_r", all_).filter(F.size("_r") > 0)
    return out.withColumns({"primary_reason": F.get("_r", F.lit(0)), "reasons": F.array_join("_r", "|"), "n_reasons": F.size("_r")}).drop("_r")


def enriched(df: DataFrame, scores: list[str], flags: dict[str, Column]) -> DataFrame:
    """Adds flags, ensemble_score (mean of scores, null as 0) and priority (sum of the flags)."""
    mean = sum((F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for s in scores), F.lit(0.0)) / max(1, len(scores))
    out = df.withColumns({n: F.coalesce(c, F.lit(0)) for n, c in flags.items()})
    return out.withColumns({"ensemble_score": mean, "priority": sum((F.col(n) for n in flags), F.lit(0))})


def group_split(df: DataFrame, group: str, shares: dict[str, float], seed: int) -> DataFrame:
    """Adds split: all rows of a group together, by the first 8 digits of its digest."""
    at = F.conv(F.substring(shuffle_key(group, seed), 1, 8), 16, 10).cast("double") / float(16**8)
    upto, case = 0.0, None
    names = list(shares)
    for name in names[:-1]:
        upto += shares[name]
        case = (F.when if case is None else case.when)(at < upto, name)
    return df.withColumn("split", F.lit(names[-1]) if case is None else case.otherwise(names[-1]))


def label_split(df: DataFrame, label: str, key: str, shares: dict[str, float], seed: int) -> DataFrame:
    """Adds split: the shares hold within every label."""
    ranked = ranked_in(df.withColumn("_s5", shuffle_key(key, seed)), [label], "_s5", key)
    at = (F.col("_rank") - 1) / F.col("_total")
    upto, case = 0.0, None
    names = list(shares)
    for name in names[:-1]:
        upto += shares[name]
        case = (F.when if case is None else case.when)(at < upto, name)
    return ranked.withColumn("split", F.lit(names[-1]) if case is None else case.otherwise(names[-1])).select(*df.columns, "split")
