import random

from pyspark.sql import functions as F

from threadloom.llm import splits

PAIR = "pair_id string, submission_id string, response_id string, claim_author string, response_author string, record string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], PAIR)


def targets(spark):
    return spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, target_share double")


def brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for p, s, r, a, b in rows:
        for e in ([f"s:{s}"] if s else []) + ([f"r:{r}"] if r else []) + [f"a:{x.lower().strip()}" for x in (a, b) if x and x.lower().strip() not in ("", "[deleted]", "automoderator")]:
            parent[find(e)] = find(f"p:{p}")
        find(f"p:{p}")
    groups = {}
    for p in {r[0] for r in rows}:
        groups.setdefault(find(f"p:{p}"), set()).add(p)
    return {(p, min(g)) for g in groups.values() if len(g) > 1 for p in g}


def test_groups_against_brute_force(spark, rows):
    rnd = random.Random(4)
    data = [(f"p{rnd.randrange(70):02d}", rnd.choice([None, "", f"s{rnd.randrange(60)}"]), f"r{k}", rnd.choice(["[deleted]", None, "Bob", f"u{rnd.randrange(80)}"]) if k % 5 == 0 else f"v{k}", rnd.choice(["AutoModerator", "", f"U{rnd.randrange(80)} "])) for k in range(90)]
    assert rows(splits.tied_groups([frame(spark, data)], targets(spark))) == brute(data)
    # In three batches, with merges, conflicting merges and repeated records between them.
    parts = [frame(spark, data[:30]), frame(spark, data[20:60]), frame(spark, data[60:])]
    assert rows(splits.tied_groups(parts, targets(spark))) == brute(data)


def test_long_chain_and_hub(spark, rows):
    chain = [(f"p{(k * 37) % 120:03d}", f"s{k}", f"r{k}", f"u{k}", f"u{k + 1}") for k in range(120)]
    assert {g for _, g in rows(splits.tied_groups([frame(spark, chain)], targets(spark)))} == {"p000"}
    hub = [(f"q{k:03d}", "hot", f"r{k}", None, None) for k in range(200)]
    assert rows(splits.tied_groups([frame(spark, hub)], targets(spark))) == {(f"q{k:03d}", "q000") for k in range(200)}


def test_shares_and_empty(spark):
    data = [(f"p{k:04d}", f"s{k // 2}", f"r{k}", None, None) for k in range(1000)]
    records, links = splits.pair_links(frame(spark, data))
    res = splits.assign(records, links, targets(spark))
    share = {r.split: r.share for r in splits.share_report(res, targets(spark)).collect()}
    assert abs(share["train"] - 0.8) < 0.02
    assert res.records.groupBy("component").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    records, links = splits.pair_links(frame(spark, []))
    assert splits.assign(records, links, targets(spark)).records.count() == 0
    assert splits.tied_groups([frame(spark, [(None, "s", "r", "a", "b")])], targets(spark)).count() == 0


def test_incremental(spark):
    t = targets(spark)
    one = splits.assign(*splits.pair_links(frame(spark, [("p1", "s1", "r1", None, None), ("p2", "s2", "r2", None, None), ("p3", "s3", "r3", None, None)])), t)
    table = one.table.withColumn("split", F.when(F.col("component") == "p3", "test").otherwise("train"))
    two = splits.assign(*splits.pair_links(frame(spark, [("p4", "s1", "r4", None, None), ("p5", "s1", "r5", "u", None), ("p6", "s2", "r6", "u", None), ("p7", "s2", "r7", "w", None), ("p8", "s3", "r8", "w", None), ("p9", None, "r9", None, None)])), t, table)
    got = {r.record: r.split for r in two.records.collect()}
    # p4 to p8 tie s1 and s2 (train) with s3 (test): quarantined; the old records keep their splits.
    assert {got[p] for p in ("p4", "p5", "p6", "p7", "p8")} == {"quarantine"} and got["p9"] in ("train", "test")
    assert two.conflicts.count() == 1
    kept = {r.node: r.split for r in two.table.collect()}
    assert kept["p:p1"] == "train" and kept["p:p3"] == "test"
    three = splits.assign(*splits.pair_links(frame(spark, [("p4", "s1", "r4", "u", None), ("p5", "s2", "r5", "u", None)])), t, table)
    assert {r.split for r in three.records.collect()} == {"train"}
    comp = {r.node: r.component for r in three.table.collect()}
    assert comp["p:p1"] == comp["p:p2"] == comp["p:p4"]


def test_merge_under_a_repeated_record(spark):
    """A batch that repeats the smallest old record merges both old components in every row of the table."""
    t = targets(spark)
    table = spark.createDataFrame([("p:a1", "a1", "train"), ("s:x", "a1", "train"), ("p:b1", "b1", "train"), ("s:y", "b1", "train")], "node string, component string, split string")
    links = spark.createDataFrame([("a1", "s:x"), ("a1", "s:y"), ("c9", "s:y")], "record string, entity string")
    got = splits.assign(links.select("record").distinct(), links, t, table)
    assert {r.node: (r.component, r.split) for r in got.table.collect()} == {n: ("a1", "train") for n in ("p:a1", "p:b1", "p:c9", "s:x", "s:y")}
    assert {(r.record, r.component, r.split) for r in got.records.collect()} == {("a1", "a1", "train"), ("c9", "a1", "train")}


def test_conflict_of_three_splits(spark):
    """All clashing splits are named; old records keep theirs, and no component of the table has two splits."""
    t = spark.createDataFrame([(s, 1 / 3) for s in ("train", "dev", "test")], "split_name string, target_share double")
    table = spark.createDataFrame([("p:a1", "a1", "train"), ("s:x", "a1", "train"), ("p:b1", "b1", "dev"), ("s:y", "b1", "dev"), ("p:c1", "c1", "test"), ("s:z", "c1", "test")], "node string, component string, split string")
    links = spark.createDataFrame([("a1", "s:y"), ("d1", "s:y"), ("d1", "s:z")], "record string, entity string")
    got = splits.assign(links.select("record").distinct(), links, t, table)
    assert {tuple(r.splits) for r in got.conflicts.collect()} == {("dev", "test", "train")} and {r.old for r in got.ties.collect()} == {"a1", "b1", "c1"}
    assert {(r.record, r.split) for r in got.records.collect()} == {("a1", "train"), ("d1", "quarantine")}
    assert got.table.groupBy("component").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert {r.split for r in got.table.filter("node in ('p:a1', 's:x')").collect()} == {"train"}
