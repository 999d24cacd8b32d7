"""Per-key results, hierarchies and orphan references on small frames and against brute force."""

import random

from pyspark.sql import functions as F

from threadloom.operators import eager, hierarchy, references

COLS = "comment_id string, parent_id string, submission_id string, level bigint, created_utc double, body string, extra string, _k string, ref_table string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "x", "y", "z") for r in rows], COLS)


def test_eager_matches_join(spark, rows):
    left = spark.createDataFrame([("A", 1), (" a ", 2), ("b", None), (None, 5), ("", 7)], "k string, v int")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("c", 1), (None, 1)], "k string, left_rows int")
    got = rows(eager.eager_join_profile(left, right, {"k": F.col("k")}, {"k": F.col("k")}, {"v": F.col("v")}), "key_value", "left_rows", "right_rows", "joined_rows", "joined_left_v_sum")
    assert got == {("a", 2, 2, 4, 6), ("b", 1, 0, 0, None), ("", 1, 0, 0, 0)}
    roll = eager.roll_up(eager.eager_join_profile(left, right, {"k": F.col("k")}, {"k": F.col("k")})).first()
    assert (roll.keys, roll.left_rows, roll.joined_rows, roll.largest_key_rows) == (3, 4, 4, 2)


def test_eager_hot_and_empty(spark, rows):
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    p = eager.eager_join_profile(hot, hot.limit(0), {"k": F.col("k")}, {"k": F.col("k")})
    assert rows(eager.heavy_keys(p, 3000)) == {("k", "hot")}
    assert rows(eager.heavy_keys(eager.eager_join_profile(hot.limit(0), hot, {"k": F.col("k")}, {"k": F.col("k")}), 0)) == set()


def brute(rows_):
    rec = {}
    for c, p, s, lvl, *_ in rows_:
        at = p is not None and (p.startswith("t3_") or p.replace("t1_", "") == s)
        rec[c] = ((p or "").replace("t1_", "").replace("t3_", "") or None, at, lvl)
    out, paths = set(), {}
    for i in rec:
        seen, x, pos, kind = [], i, {}, None
        while True:
            if x in pos:
                kind = "cycle" if pos[x] == 0 else "below_cycle"
                break
            pos[x] = len(seen)
            seen.append(x)
            p, at, _ = rec.get(x, (None, False, None))
            if at:
                kind, paths[i] = "tree", [p, *reversed(seen)]
                break
            if p is None:
                break
            x = p
        if kind in ("cycle", "below_cycle"):
            out.add((i, kind))
        elif kind == "tree" and rec[i][2] is not None and rec[i][2] != len(seen):
            out.add((i, "level_mismatch"))
    return out, paths


def random_tree(seed, n):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        r = rnd.random()
        parent = "t3_s" if r < 0.05 else None if r < 0.07 else f"c{k - 1}" if r < 0.7 and k else f"t1_c{rnd.randrange(n)}" if r < 0.75 else f"c{rnd.randrange(max(1, k))}" if k else "s"
        out.append((f"c{k}", parent, "s", rnd.choice([None, 1, 2, 3]), 0.0, "b"))
    return out


def test_hierarchy_against_brute_force(spark, rows):
    for seed, n, split in ((1, 60, 8), (2, 300, 3), (3, 300, 50)):
        data = random_tree(seed, n)
        want, paths = brute(data)
        got = hierarchy.comment_hierarchy(frame(spark, data + data[:9]), split)
        assert rows(hierarchy.findings(got)) == want
        assert {r.comment_id: list(r.path) for r in got.filter("path is not null").collect()} == paths
    down = {(a, d) for d, p in paths.items() for a in p[:-1]}
    assert rows(hierarchy.descendants(got), "ancestor_id", "descendant_id") == down


def test_hierarchy_deep_chain_and_self_parent(spark):
    chain = [("c0", "t3_s", "s", 1, 0.0, "")] + [(f"c{k}", f"c{k - 1}", "s", k + 1, 0.0, "") for k in range(1, 400)]
    loops = [("x", "x", "s", 1, 0.0, ""), ("y", "x", "s", 1, 0.0, ""), ("p", "q", "s", 1, 0.0, ""), ("q", "p", "s", 1, 0.0, "")]
    h = hierarchy.comment_hierarchy(frame(spark, chain + loops), 5)
    assert h.filter("kind = 'tree'").agg(F.max("depth")).first()[0] == 400
    assert {(r.comment_id, r.kind, r.cycle_id) for r in h.filter("kind <> 'tree'").collect()} == {("x", "cycle", "x"), ("y", "below_cycle", None), ("p", "cycle", "p"), ("q", "cycle", "p")}


def test_every_path(spark, rows, tmp_path):
    """Open chains and cycles have paths and descendants too."""
    from threadloom.plans import core

    for seed, n in ((4, 60), (5, 300)):
        data = random_tree(seed, n) + [("x", "x", "s", 1, 0.0, ""), ("u", "absent", "s", 1, 0.0, ""), ("v", "u", "s", 1, 0.0, "")]
        data += [(f"r{k}", f"r{(k + 1) % 7}", "s", 1, 0.0, "") for k in range(7)] + [("b0", "r3", "s", 1, 0.0, ""), ("b1", "b0", "s", 1, 0.0, "")]
        _, want = brute(data)
        parent = {c: (p or "").replace("t1_", "") or None for c, p, *_ in data}
        for i in parent.keys() - want.keys():
            path = [i]
            while parent.get(path[0]) in parent and parent[path[0]] not in path:
                path.insert(0, parent[path[0]])
            want[i] = path
        frame(spark, data).write.parquet(f"{tmp_path}/{seed}/comments.parquet")
        got = core.p4_paths(spark, f"{tmp_path}/{seed}").collect()
        assert {r.comment_id: list(r.path) for r in got} == want
        assert all((r.depth is None) == (r.kind != "tree") for r in got)
        down = [(a, d, len(p) - 1 - k) for d, p in want.items() for k, a in enumerate(p[:-1])]
        assert sorted(map(tuple, core.p4_descendants(spark, f"{tmp_path}/{seed}").collect())) == sorted(down)


def test_hierarchy_empty_and_null(spark):
    assert hierarchy.comment_hierarchy(frame(spark, [])).count() == 0
    got = hierarchy.comment_hierarchy(frame(spark, [(None, "a", "s", 1, 0.0, ""), ("a", "", None, None, None, None)])).collect()
    assert [(r.comment_id, r.kind, r.depth) for r in got] == [("a", "open", None)]


def test_orphans(spark, rows):
    day = 86400.0
    data = [
        ("a", "t3_s", "s", 1, 10 * day, "x"), ("b", "t1_a", "s", 2, 9 * day, "x"), ("c", "zz", "s", 2, 40 * day, "x"), ("d", "A ", "s", 2, None, "x"), ("e", "t3_gone", "s", 1, 11 * day, "x"),
        ("f", "t1_g", "s", 1, 12 * day, "x"), ("g", "s", "s", 1, 80 * day, "[Deleted] "), ("g", "t3_s", "s", 1, 80 * day, "[removed]"), ("h", "t1_i", "s", 1, 12 * day, "x"), ("i", "s", "s", 1, 12 * day, "[deleted]"), ("i", "s", "s", 1, 12 * day, None),
        ("j", None, "s", 1, 1.0, "x"), (None, "zz", "s", 1, 1.0, "x"), ("k", " ", "s", 1, 1.0, "x"),
    ]
    subs = spark.createDataFrame([("T3_S", 10.5 * day, "q"), ("s", None, "q")], "submission_id string, created_utc double, comment_id string")
    got = rows(references.orphan_references(frame(spark, data), subs))
    assert got == {
        ("a", "submissions", "late", "1970-01"), ("b", "comments", "late", "1970-01"), ("c", "comments", "missing", "1970-02"), ("e", "submissions", "missing", "1970-01"),
        ("f", "comments", "late", "1970-01"), ("f", "comments", "deleted", "1970-01"),
    }
    assert rows(references.orphan_references(frame(spark, []), subs)) == set()
    assert ("a", "submissions", "missing", "1970-01") in rows(references.orphan_references(frame(spark, data), subs.limit(0)))


def test_bitmaps_round_trip():
    import numpy as np

    for n in (0, 1, 500, 5000, 32768):
        at = np.random.default_rng(n).choice(references.RANGE, n, replace=False)
        flags = np.zeros(references.RANGE, np.uint8)
        flags[at] = 1
        raw = np.packbits(flags, bitorder="little").tobytes()
        assert references.unpack(references.pack(raw)).tobytes() == raw
    assert references.unpack(None).sum() == 0
