"""Hot keys: a third of all rows on one key, in one day or one second. Plans change, results don't."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from threadloom import runtime
from threadloom.operators import hierarchy, history, metrics, pairs, references, sampling, simulation
from threadloom.operators.records import in_order

REC = "comment_id string, submission_id string, author string, subreddit string, grp string, created_utc double, pred bigint, claim boolean"


@pytest.fixture
def split_all(monkeypatch):
    """No table is too small to have its hot keys split."""
    return lambda: monkeypatch.setattr(runtime, "TASK_BYTES", 0)


def crowd(spark, n=3000):
    """A third of the rows in one thread by one author within one day, a part of them in one second."""
    rnd = random.Random(5)
    rows = []
    for k in range(n):
        hot = k % 3 == 0
        t = 5e5 + (7.0 if k % 9 == 0 else rnd.randrange(80_000)) if hot else rnd.randrange(10**6)
        rows.append((f"c{rnd.randrange(10**9):09d}{k}", "hot" if hot else f"s{rnd.randrange(300)}", "busy" if hot else f"u{rnd.randrange(200)}", f"r{rnd.randrange(4)}", f"g{rnd.randrange(3)}", float(t), rnd.randrange(2), rnd.random() < 0.1))
    return runtime.Scratch(spark, "crowd").keep(spark.createDataFrame(rows, REC))


def test_order_and_history_with_a_hot_thread(spark, rows, split_all):
    r = crowd(spark)
    want = rows(in_order(r), "comment_id", "rank", "thread_start"), rows(history.pair_history(r)), rows(pairs.nearest_prior_claim(r, F.col("claim")))
    split_all()
    assert (rows(in_order(r), "comment_id", "rank", "thread_start"), rows(history.pair_history(r)), rows(pairs.nearest_prior_claim(r, F.col("claim")))) == want
    cut, several = runtime.cut_hot(r, "submission_id", ["created_utc", "comment_id"])
    sizes = [x["count"] for x in cut.filter("submission_id = 'hot'").groupBy("_slice").count().collect()]
    assert several and len(sizes) > 30 and max(sizes) <= 3 * median(sizes)


def test_hierarchy_and_references_with_a_hot_parent(spark, rows, split_all):
    rnd = random.Random(8)
    data = [("top", "t3_s", "s", 1, 0.0, "x")] + [(f"c{k}", "t1_top" if k % 3 == 0 else f"c{rnd.randrange(k)}" if k % 3 == 1 and k else rnd.choice(["t3_s", "absent", f"c{k}"]), "s", rnd.choice([None, 2]), float(rnd.randrange(10**7)), "x") for k in range(600)]
    frame = spark.createDataFrame(data, "comment_id string, parent_id string, submission_id string, level bigint, created_utc double, body string")
    subs = spark.createDataFrame([("s", 5e6)], "submission_id string, created_utc double")
    show = lambda: (rows(hierarchy.comment_hierarchy(frame, every_path=True).withColumn("path", F.array_join("path", "/"))), rows(references.orphan_references(frame, subs)))
    want = show()
    split_all()
    assert show() == want
    nodes = hierarchy.comment_nodes(frame)
    assert runtime.hot_keys(nodes, "parent")[0] == "top"


def test_join_hot_is_a_join(spark, rows):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5)], "k string, v int")
    right = spark.createDataFrame([("a", "x"), ("c", "y")], "k string, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(runtime.join_hot(left, right, "k", ["a", "zz"], how)) == rows(left.join(right, "k", how))


def test_claims_beyond_the_broadcast(spark, rows):
    words = ["masks", "zinc pills", "5g", "magnets", "x"]
    rnd = random.Random(3)
    posts = spark.createDataFrame([(k, None if k == 0 else " ".join(rnd.choice([*words, "and", "Masks!"]) for _ in range(4))) for k in range(120)] + [(999, "")], "id int, title string")
    claims = spark.createDataFrame([("c1", ['"zinc pills" "masks"', "5g"]), ("c2", ["magnets x"]), ("c3", []), ("c4", ["x"]), ("c5", None)], "claim_id string, queries array<string>")
    few, many = (rows(pairs.claim_matches(posts, claims, "title", "id", limit=n)) for n in (10**9, -1))
    assert few == many and len(few) > 100
    assert max(n for (_, n) in rows(pairs.claim_matches(posts, claims, "title", "id", 2).groupBy("claim_id").count())) == 2


def test_bootstrap_is_repeatable_and_near(spark, rows):
    rnd = random.Random(2)
    df = spark.createDataFrame([(rnd.random(), int(rnd.random() < 0.4)) for _ in range(400)], "score double, y int")
    a = simulation.bootstrap(df.repartition(3), 60)
    assert rows(a) == rows(simulation.bootstrap(df.coalesce(1), 60))
    own = metrics.ranking(df).first()
    got = a.agg(F.avg("roc_auc").alias("auc"), F.stddev("roc_auc").alias("sd"), F.count("*").alias("n")).first()
    assert got.n == 60 and abs(got.auc - own.roc_auc) < 0.03 and 0.01 < got.sd < 0.06


def test_two_caps_against_row_by_row(spark):
    rnd = random.Random(4)
    data = [(f"p{k:03d}", f"r{k // 3 if k % 2 else rnd.randrange(40) * 100}", None, rnd.choice("ab"), rnd.randrange(5)) for k in range(200)]
    data = [(p, r, f"s{hash(r) % 7}" if r != "r0" else None, c, v) for p, r, _, c, v in data]
    df = runtime.Scratch(spark, "t").keep(spark.createDataFrame(data, "pair_id string, response_id string, submission_id string, c string, v int"))
    got = sampling.greedy(df, {"a": (F.col("c") == "a", 9), "b": (F.col("c") == "b", 6)}, "pair_id", {"response_id": 2, "submission_id": 3}, [F.desc("v")], 19)
    taken, per = [], {}
    for name, quota, pool in (("a", 9, "a"), ("b", 6, "b"), ("fill", None, "ab")):
        count = 0
        for p, r, s, c, v in sorted(data, key=lambda x: (-x[4], x[0])):
            if c in pool and p not in [t[0] for t in taken] and per.get(r, 0) < 2 and per.get(s or "", 0) < 3 and (count < quota if quota else len(taken) < 19):
                taken.append((p, name))
                per[r], per[s or ""], count = per.get(r, 0) + 1, per.get(s or "", 0) + 1, count + 1
    assert [(r.pair_id, r.taken_as) for r in got.orderBy("place").collect()] == taken
    assert sampling.parse_quotas(" b=2, a = 10,") == {"b": 2, "a": 10}


def test_network_draws_against_brute_force(spark):
    """With coefficients that do not vary every metric follows from the states, which the outcomes fix for the baseline."""
    import numpy as np

    from threadloom.operators.estimation import Design

    focal = spark.createDataFrame([("a", "s", 1.0, 1, 0.0), ("b", "s", 2.0, 1, 1.0), ("c", "s", 3.0, 0, 1.0), ("d", "z", 1.0, 0, 0.0)], "comment_id string, submission_id string, created_utc double, outcome int, x double")
    comments = spark.createDataFrame([("a", "s", 1.0), ("b", "s", 2.0), ("c", "s", 3.0), ("e", "s", 3.0), ("d", "z", 1.0), ("f", "z", 5.0)], "comment_id string, submission_id string, created_utc double")
    above = spark.createDataFrame([("a", "b"), ("a", "e"), ("b", "e"), ("d", "f"), ("c", "gone")], "ancestor_id string, descendant_id string")
    d = Design(["x"])
    got = simulation.network_draws(focal, comments, above, {"baseline": (d, {}), "on": (d, {"x": F.lit(60.0)})}, {"baseline": ("baseline", "baseline", F.lit(0.0)), "all": ("on", "on", F.lit(0.0))}, "baseline", np.array([0.0, 0.5]), np.zeros((2, 2)), 30).collect()
    base = {tuple(round(r[n], 6) for n in simulation.NETWORK) for r in got if r.scenario == "baseline"}
    # a and b correct: half of the focal ones, one thread of two, b, c and e come after a, b and e lie below a.
    assert base == {(0.5, 0.5, 0.5, round(2 / 6, 6))}
    assert {tuple(round(r[n], 6) for n in simulation.NETWORK) for r in got if r.scenario == "all"} == {(1.0, 1.0, round(4 / 6, 6), 0.5)}
    assert len(got) == 60


def test_incomplete_rows_leave_a_model(spark):
    from threadloom.operators import estimation

    full = [(float(k % 5), "a" if k % 2 else "b", int(k % 3 == 0)) for k in range(60)]
    schema = "x double, g string, y int"
    d = estimation.Design(["x"], {"g": ["a", "b"]})
    own = estimation.fit_logit(spark.createDataFrame(full, schema), d, "y")
    more = estimation.fit_logit(spark.createDataFrame([*full, (None, "a", 1), (1.0, None, 1), (1.0, "new", 0), (float("nan"), "a", 1)], schema), d, "y")
    assert own.n == more.n == 60 and max(abs(own.beta - more.beta)) < 1e-9


def by_rows(scores, labels, replicates, seed):
    """Average precision, ROC AUC and F1 of resamples drawn row by row; ties share a threshold."""
    import numpy as np

    rng, order = np.random.default_rng(seed), np.argsort(-scores)
    s, pos = scores[order], labels[order] == 1
    last = np.r_[s[1:] != s[:-1], True]
    out = []
    for _ in range(replicates):
        w = rng.poisson(1, len(s))
        tp, n = np.cumsum(w * pos)[last], np.cumsum(w)[last]
        p, m = np.diff(tp, prepend=0), np.diff(n - tp, prepend=0)
        hit = s >= 0.5
        out.append(((p * tp / np.maximum(n, 1)).sum() / tp[-1], (p * (m.sum() - np.cumsum(m) + m / 2)).sum() / (tp[-1] * m.sum()), 2 * w[hit & pos].sum() / (w[hit].sum() + tp[-1])))
    return np.array(out)


def test_bootstrap_in_slices_against_row_by_row(spark, monkeypatch):
    """Many slices, two groups (one of them null), ties: means, deviations and correlations as those of row-by-row resamples."""
    import numpy as np

    monkeypatch.setattr(simulation, "SLICE_CELLS", 16)
    monkeypatch.setattr(simulation, "BLOCK", 4096)
    rng = np.random.default_rng(5)
    scores = np.round(rng.random(600), 3)
    labels = (rng.random(600) < 0.1 + 0.3 * scores).astype(int)
    rows = [(g, float(s), int(y)) for g, most in (("a", 600), (None, 300)) for s, y in zip(scores[:most], labels[:most])] + [("a", None, 1), ("a", 0.5, None), ("one class", 0.4, 1)]
    df = spark.createDataFrame(rows, "g string, score double, y int")
    got = simulation.bootstrap(df.repartition(3), 3000, by=["g"]).toPandas()
    again = simulation.bootstrap(df.coalesce(1), 3000, by=["g"]).toPandas()
    order = ["g", "replicate"]
    assert got.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    assert set(got["g"].fillna("null")) == {"a", "null"}
    for own, most in ((got[got["g"] == "a"], 600), (got[got["g"].isna()], 300)):
        have, want = own[["average_precision", "roc_auc", "f1"]].to_numpy(), by_rows(scores[:most], labels[:most], 3000, 7)
        assert len(have) == 3000
        sd = want.std(0)
        assert (abs(have.mean(0) - want.mean(0)) < 5 * sd * (2 / 3000) ** 0.5).all() and (abs(have.std(0) / sd - 1) < 0.08).all()
        assert (abs(np.corrcoef(have.T) - np.corrcoef(want.T)) < 0.09).all()


def test_bootstrap_offsets_are_exact(spark, monkeypatch):
    """Scores that part the classes, upwards or downwards, do so in every resample, over all slices; equal ones never."""
    monkeypatch.setattr(simulation, "SLICE_CELLS", 16)
    rows = [("up", k / 300, int(k >= 200)) for k in range(300)] + [("down", k / 300, int(k < 100)) for k in range(300)] + [("tied", 0.7, k % 3) for k in range(300)]
    rows += [("nan", float("nan") if k % 2 else k / 300, k % 2) for k in range(300)]
    got = simulation.bootstrap(spark.createDataFrame(rows, "g string, score double, y int"), 100, by=["g"]).collect()
    assert len(got) == 400
    for r in got:
        if r.g in ("up", "nan"):
            assert abs(r.average_precision - 1) < 1e-12 and r.roc_auc == 1.0
        elif r.g == "down":
            assert r.average_precision < 0.3 and r.roc_auc == r.f1 == 0.0
        else:
            assert r.roc_auc == 0.5 and abs(r.f1 - 2 * r.average_precision / (1 + r.average_precision)) < 1e-12
    assert len({round(r.f1, 9) for r in got if r.g == "tied"}) > 50


def test_bootstrap_keeps_rows_few(spark):
    """Ten thousand different scores, 200 resamples, two groups: what travels is of slices and resamples, not of scores and resamples."""
    df = spark.range(20000).select((F.col("id") % 2).cast("string").alias("g"), (F.floor(F.col("id") / 2) / 10000).alias("score"), (F.col("id") % 100 < 2).cast("int").alias("y"))
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, none, sc._jvm.java.util.ArrayList())
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    before = written()
    assert simulation.summarise(simulation.bootstrap(df, 200, by=["g"]), "g", ["roc_auc"]).count() == 2
    after = [n for k, n in written().items() if k not in before]
    assert 0 < sum(after) < 100_000


def test_bootstrap_is_one_plan(spark):
    """The plan that the driver holds is the same for any number of resamples: no part of it is repeated per so many of them; no rows give no draws."""
    df = spark.range(50).select((F.col("id") / 50).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    few, many = (simulation.bootstrap(df, n)._jdf.queryExecution().executedPlan().toString() for n in (10, 2000))
    assert few.count("Exchange") == many.count("Exchange") < 8 and "Union" not in many
    assert simulation.bootstrap(df.limit(0), 10).count() == 0


def test_bootstrap_broadcasts_nothing(spark):
    """The plan as it ran sends no drawn rows through the driver: they are many times what they are drawn from, which a planner may not foresee."""
    df = spark.range(300).select((F.col("id") / 300).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    draws = simulation.bootstrap(df, 20)
    assert len(draws.collect()) == 20
    ran = draws._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in ran and "Broadcast" not in ran
