"""Semantics of order, history and context on hand-made frames; estimation and metrics against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import cohort, estimation, history, metrics, modeling, pairs, profiles, sampling, sets, simulation
from threadloom.sources import files, schemas
from threadloom.streaming import threads

REC = "comment_id string, submission_id string, parent_id string, author string, subreddit string, grp string, created_utc double, body string, title string, candidate bigint, score double, pred bigint, pair_count bigint, best_pair string, words bigint, hostile bigint, anti bigint"


def recs(spark, rows):
    """rows: id, thread, author, time[, subreddit[, pred]]"""
    out = []
    for r in rows:
        cid, sub, who, t, *more = r
        out.append((cid, sub, None, who, more[0] if more else "s", "g", float(t), "b", "t", 1, 0.5, more[1] if len(more) > 1 else 0, 0, None, 1, 0, 0))
    return spark.createDataFrame(out, REC)


def test_history_is_strictly_before(spark):
    r = recs(spark, [("a", "t1", "u", 99), ("b", "t1", "u", 100), ("c", "t1", "u", 101), ("d", "t2", "v", 100), ("e", "t2", "u", 150)])
    h = {(x.submission_id, x.author): x.prior_comments for x in history.pair_history(r).collect()}
    assert h[("t2", "u")] == 1 and h[("t1", "u")] == 0


def test_history_over_slices_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{k}", f"t{rng.integers(12)}", f"u{rng.integers(3)}", int(rng.integers(0, 60)) * 86400, f"s{rng.integers(4)}", int(rng.integers(2))) for k in range(200)]
    got = {(x.submission_id, x.author): (x.prior_comments, x.prior_subreddits, x.prior_corrections) for x in history.pair_history(recs(spark, rows)).collect()}
    start = {t: min(r[3] for r in rows if r[1] == t) for t in {r[1] for r in rows}}
    for (t, u), want in got.items():
        before = [r for r in rows if r[2] == u and r[3] < start[t]]
        assert want == (len(before), len({r[4] for r in before}), sum(r[5] for r in before))


def test_tied_timestamps_are_on_neither_side(spark):
    rows = [(f"c{k:02d}", "t", f"u{k}", k if k < 9 else 9 if k < 11 else 20 + k) for k in range(12)]
    side = {r.comment_id: r.side for r in cohort.context_split(recs(spark, rows)).collect()}
    assert sum(v == "early" for v in side.values()) == 10 and "c10" not in side and side["c11"] == "later"


def test_entropy_mode_and_empty(spark):
    r = recs(spark, [("a", "t", "u", 1, "b"), ("b", "t", "u", 2, "a"), ("c", "t", "u", 3, "b"), ("d", "t", "u", 4, "a"), ("e", "t", None, 5, "z")])
    u = profiles.user_profiles(r).first()
    assert u.dominant_subreddit == "b" and u.subreddit_entropy == pytest.approx(math.log(2)) and u.comments == 4
    assert profiles.user_profiles(r.limit(0)).count() == 0 and profiles.climate(r.limit(0)).count() == 0
    assert cohort.cohort(r.limit(0)).count() == 0


def test_nearest_claim(spark):
    r = recs(spark, [("c1", "t", "u", 1), ("c2", "t", "v", 2), ("c3", "t", "w", 3)])
    got = {x.comment_id: x.claim_id for x in pairs.nearest_prior_claim(r, F.col("comment_id").isin("c1", "c3")).collect()}
    assert got == {"c1": None, "c2": "c1", "c3": "c1"}


def test_metrics_with_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)], "score double, y int")
    m = metrics.ranking(df).first()
    assert m.average_precision == pytest.approx(0.8333, abs=1e-4) and m.roc_auc == pytest.approx(0.875)
    one = metrics.ranking(df.filter("y = 1")).first()
    assert one.roc_auc is None
    q = {r.term: round(r.q, 4) for r in metrics.benjamini_hochberg(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.2)], "term string, p double")).collect()}
    assert q == {"a": 0.04, "b": 0.0533, "c": 0.0533, "d": 0.2}


def test_quota_and_caps(spark):
    df = spark.createDataFrame([(f"p{k}", "a" if k < 4 else "b", float(k)) for k in range(6)], "id string, g string, s double")
    got = {r.id for r in sampling.quota_capped(df, {"x": (F.lit(True), 3)}, "id", "g", 2, F.col("s")).collect()}
    assert got == {"p5", "p4", "p3"}


def test_union_first_wins(spark):
    a = spark.createDataFrame([("1", "k", "x"), ("2", None, "y"), ("3", " ", "z")], "n string, k string, v string")
    b = spark.createDataFrame([("4", "k", "w"), ("5", None, "q")], "n string, k string, v string")
    assert {r.n for r in sets.union_first_wins([a, b], ["k"], "n").collect()} == {"1", "2", "3", "5"}


def test_logit_and_clusters_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 400
    x, g, a = rng.normal(size=n), rng.integers(0, 20, n), rng.integers(0, 15, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + 0.8 * x)))).astype(int)
    df = spark.createDataFrame([(float(x[i]), int(y[i]), f"g{g[i]}", f"a{a[i]}") for i in range(n)], "x double, y int, g string, a string")
    fit = estimation.fit_logit(df, estimation.Design(["x"]), "y", ("g", "a"))
    m = np.c_[np.ones(n), x]
    p = 1 / (1 + np.exp(-m @ fit.beta))
    assert np.abs(m.T @ (y - p)).max() < 1e-4 and fit.converged
    s = m * (y - p)[:, None]

    def meat(keys):
        u = {}
        for k, row in zip(keys, s):
            u[k] = u.get(k, 0) + row
        c = len(u)
        return sum(np.outer(v, v) for v in u.values()) * c / (c - 1) * (n - 1) / (n - 2)

    bread = np.linalg.inv((m.T * (p * (1 - p))) @ m)
    want = bread @ (meat(g) + meat(a) - meat(list(zip(g, a)))) @ bread
    assert np.allclose(fit.covariance, want, rtol=1e-4)
    ols = estimation.fit_ols(df, estimation.Design(["x"]), "y", ("g",))
    assert np.allclose(ols.beta, np.linalg.lstsq(m, y, rcond=None)[0])
    assert estimation.nearest_psd(np.array([[1.0, 2.0], [2.0, 1.0]]))[1] == 1


def test_bootstrap_and_runs(spark):
    df = spark.createDataFrame([(k / 50, int(k % 3 == 0)) for k in range(50)], "score double, y int")
    a, b = simulation.bootstrap(df, 5).collect(), simulation.bootstrap(df, 5).collect()
    assert sorted(a) == sorted(b) and len(a) == 5
    inst = spark.createDataFrame([("t", "u", 1.0), ("t", "v", 0.0)], "submission_id string, author string, p double")
    runs = simulation.bernoulli_runs(inst, {"as_is": F.col("p"), "none": F.lit(0.0)}, 3).collect()
    assert {(r.scenario, r.correcting) for r in runs} == {("as_is", 1), ("none", 0)}


def test_files(spark, tmp_path):
    d = str(tmp_path)
    df = spark.createDataFrame([("b", 'x "q"\nline', None), ("a", "", 1.5)], "k string, body string, v double")
    assert files.write_jsonl(df, f"{d}/j") == 2
    back = files.read_jsonl(spark, f"{d}/j", df.schema)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    files.write_csv(df, f"{d}/c", ["k", "body"])
    assert {tuple(r) for r in files.read_csv(spark, f"{d}/c").collect()} == {("b", 'x "q"\nline'), ("a", "")}
    with pytest.raises(ValueError):
        files.write_csv(df, f"{d}/x", ["k"], strict=True)
    (tmp_path / "arc").write_text('{"id": "1"}\n\nnot json\n{"id": "2"}\n')
    good, bad = files.read_archive(spark, f"{d}/arc", schemas.ARCHIVE_COMMENTS)
    assert (good.count(), bad.count()) == (2, 1)
    import zstandard

    (tmp_path / "arc.zst").write_bytes(zstandard.compress(b'{"id": "1"}\nbroken\n'))
    good, bad = files.read_archive(spark, f"{d}/arc.zst", schemas.ARCHIVE_COMMENTS)
    assert (good.count(), bad.count()) == (1, 1)
    (tmp_path / ".env").write_text("# c\nA=1\nB='two'\n")
    assert files.load_env(f"{d}/.env") == {"A": "1", "B": "two"}
    run = files.Run(f"{d}/run")
    run.table("t", df)
    run.summary["rows"] = 2
    run.close()
    files.write_report(f"{d}/run/report.md", "Run", {"rows": 12345})
    assert "12,345" in (tmp_path / "run/report.md").read_text()
    assert files.list_files(spark, f"{d}/run", "*.json").count() == 1


def test_reply_tree(spark):
    tree = '[{"kind":"t1","data":{"id":"a","replies":{"data":{"children":[{"kind":"t1","data":{"id":"b","replies":""}}]}}}},{"kind":"more","data":{}}]'
    spark.udtf.register("flatten_replies", files.FlattenReplies)
    got = spark.createDataFrame([(tree,)], "t string").createOrReplaceTempView("trees")
    assert got is None
    assert [(r.depth, r.comment_id) for r in spark.sql("SELECT f.* FROM trees, LATERAL flatten_replies(t) f").collect()] == [(0, "a"), (1, "b")]


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.createDataFrame([(1, "2024-01-01 00:10:00", "x", 1.0), (2, "2024-01-01 00:50:00", "x", 2.0), (3, "2024-01-01 01:10:00", "y", 3.0)], "user_id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    ev.write.parquet(f"{tmp_path}/ev")
    q = threads.windows(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/ev"), "1 hour", late="1 hour").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("w").collect()} == {tuple(r) for r in threads.windows(ev, "1 hour").collect()}
    assert threads.sessions(ev).count() == 3


def test_classifier_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f"good text {k}", 1.0) for k in range(10)] + [(f"bad words {k}", 0.0) for k in range(10)] + [("", 0.0)], "text string, label double")
    model = modeling.trainer(features=256).fit(df)
    modeling.save(model, f"{tmp_path}/m")
    got = modeling.score(modeling.load(f"{tmp_path}/m"), df)
    assert got.filter("pred = label").count() >= 20
    with pytest.raises(ValueError):
        modeling.feature_text("other")


def test_pair_classifier_scores_every_pair(spark, tmp_path):
    from threadloom.plans import models

    data = [(f"a{k}", f"r{k}", "claim", "title", "x " * 500 + ("source wrong" if k % 2 else "fine thanks"), k % 2) for k in range(24)] + [("null", None, None, None, None, None)]
    spark.createDataFrame(data, "annotation_id string, response_id string, claim_text string, submission_title string, response_body string, response_has_correction_cue int").write.parquet(f"{tmp_path}/candidate_pairs.parquet")
    got = models.pair_classifier(spark, str(tmp_path)).collect()
    assert {r.annotation_id for r in got} == {d[0] for d in data} and len(got) == len(data)
    assert all(r.pred == r.label for r in got if r.annotation_id != "null")
