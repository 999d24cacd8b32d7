"""Leaks, mixtures and stuffed pages."""

import random

from threadloom.llm import leakage, mixture, stuffing

WORDS = [f"w{k}" for k in range(400)]
DOC = "doc_id bigint, text string, source string, item_id string"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(k, t, (sources or {}).get(k, "a"), "x") for k, t in enumerate(texts)], DOC)


def brute(texts, items):
    out = set()
    for d, t in enumerate(texts):
        w = leakage.words(t or "")
        for i, item in items:
            v = leakage.words(item)
            if not v:
                continue
            runs = {tuple(v[k : k + 12]) for k in range(len(v) - 11)}
            if any(tuple(w[k : k + 12]) in runs for k in range(len(w) - 11)) or any(sum(a != b for a, b in zip(w[k : k + len(v)], v)) <= len(v) // 5 for k in range(len(w) - len(v) + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark, rows):
    rnd = random.Random(2)
    items = [(k, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(3, 70)))) for k in range(25)] + [(90, "a b"), (91, "")]
    texts = []
    for _ in range(120):
        base = [rnd.choice(WORDS) for _ in range(rnd.randrange(0, 200))]
        v = rnd.choice(items)[1].split()
        how = rnd.randrange(4)
        if how == 0 and len(v) > 13:
            k = rnd.randrange(len(v) - 11)
            v = v[k : k + rnd.choice([10, 11, 12])]
        elif how == 1:
            v = [rnd.choice(WORDS) if rnd.random() < 0.15 else x for x in v]
        elif how == 2:
            v = [x if k % 5 else "zzz" for k, x in enumerate(v, 1)]
        at = rnd.randrange(len(base) + 1)
        texts.append(" ".join(base[:at]) + " <b>" + ", ".join(v).upper() + "</b> " + " ".join(base[at:]))
    texts += [None, "", "x " * 50_000]
    it = spark.createDataFrame([(i, t, "s", "q") for i, t in items] + [(None, "a b c d", "s", "q"), (95, None, "s", "q"), (items[0][0], items[0][1], "s", "q")], "item_id bigint, text string, suite string, doc_id string")
    want = brute(texts, items)
    assert rows(leakage.find_leaks(docs(spark, texts), it)) == want and len(want) > 40
    assert rows(leakage.find_leaks(docs(spark, texts), it, block=7)) == want
    assert leakage.find_leaks(docs(spark, texts), it.limit(0)).count() == 0
    assert leakage.find_leaks(docs(spark, []), it).count() == 0


def test_mixture_shares_and_repeats(spark):
    texts = ["some words of a text here. " * 10] * 300
    src = {k: " A " if k < 200 else "b" if k < 290 else None if k < 295 else "other" for k in range(300)}
    goal = spark.createDataFrame([("a", 0.5, 1), ("B", 0.5, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed = mixture.mix(docs(spark, texts, src), goal, block_tokens=400)
    report = {r.source: r for r in mixture.shares(mixed, goal).collect()}
    assert abs(report["a"].share - 0.5) < 0.03 and report["b"].most_uses <= 3 and report["a"].most_uses == 1
    # A document may be cut where a block ends: its pieces never overlap, and blocks are equal.
    used = {}
    for r in mixed.collect():
        used.setdefault((r.doc_id, r["pass"]), []).append((r.first_token, r.first_token + r.n_tokens))
    assert all(a[1] <= b[0] for spans in used.values() for a, b in zip(sorted(spans), sorted(spans)[1:]))
    assert mixed.groupBy("slot").sum("n_tokens").select("sum(n_tokens)").distinct().count() == 1
    first = mixed.filter("slot < 20").groupBy("source").count().collect()
    assert len(first) == 2  # every stretch is mixed
    assert mixture.mix(docs(spark, []), goal).count() == 0
    assert mixture.mix(docs(spark, [None, ""]), goal).count() == 0
    assert sorted(mixture.mix(docs(spark, texts, src), goal, 400).collect()) == sorted(mixed.collect())


def test_mixture_with_a_tiny_source(spark):
    """A source of a few tokens bounds the mixture but does not empty it."""
    texts = ["some words of a text here. " * 100] * 20 + ["two words"]
    goal = spark.createDataFrame([("a", 0.99, 1), ("b", 0.01, 1)], "source string, target_share double, max_repeats int")
    mixed = mixture.mix(docs(spark, texts, {20: "b"}), goal)
    report = {r.source: r for r in mixture.shares(mixed, goal).collect()}
    assert report["b"].tokens == 2 and abs(report["b"].share - 0.01) < 0.005 and report["a"].most_uses == 1
    only = mixture.mix(docs(spark, ["word"]), spark.createDataFrame([("a", 1.0, 2)], goal.schema)).collect()
    assert [(r.slot, r["pass"], r.n_tokens) for r in sorted(only)] == [(0, 0, 1), (1, 1, 1)]


def test_short_items_and_first_pass(spark, rows):
    """Items of one or two words are found whole; with many items the corpus is sifted once and nothing is lost."""
    items = [(1, "rare Word"), (2, "single"), (3, "..."), *[(k, " ".join(f"i{k}x{j}" for j in range(15))) for k in range(4, 20)]]
    it = spark.createDataFrame([(i, t, "s", "q") for i, t in items], "item_id bigint, text string, suite string, doc_id string")
    texts = ["a rare, word here", "rare and word", "SINGLE", "", *[f"lead in {t} and out" for _, t in items[3:]]]
    want = {(0, 1), (2, 2)} | {(4 + n, i) for n, (i, _) in enumerate(items[3:])}
    assert rows(leakage.find_leaks(docs(spark, texts), it)) == want
    assert rows(leakage.find_leaks(docs(spark, texts), it, block=5)) == want
    rest = it.filter("item_id > 3")
    assert rows(leakage.find_leaks(docs(spark, texts), rest, block=5)) == {(d, i) for d, i in want if i > 3}
    sieve = leakage.Sieve(t for _, t in items[3:])
    assert sieve.keep(texts, leakage._Memo(sieve.vocabulary)).tolist() == [False] * 4 + [True] * 16


def test_schedule_ranks(spark):
    got = mixture.schedule(spark, [("a", 0.7), ("b", 0.3)], 10_000).collect()
    for s, w in (("a", 0.7), ("b", 0.3)):
        ranks = [r["rank"] for r in sorted(got) if r.source == s]
        assert ranks == list(range(len(ranks))) and abs(len(ranks) - 10_000 * w) < 10


def pages(n, seed):
    rnd = random.Random(seed)
    prose = ["The council said that the report was not ready for the public and it would take a while to finish it.", "We went to the market with my sister and then we had lunch by the river.", "Nobody knows how the case was decided, but there is a note about it in the file.", "He asked me what I had seen on the way and I told him about the old bridge."]
    things = ["mask", "strap", "zinc", "tablet", "cheap", "filter", "lamp", "kit"]
    out = []
    for k in range(n):
        how = k % 4
        if how == 0:
            out.append((" ".join(rnd.choice(things) + " " + rnd.choice(things) + rnd.choice([",", " |", ";"]) for _ in range(80)), 1))
        elif how == 1:
            out.append(("\n".join(f"http://shop{rnd.randrange(3)}.example/p/{rnd.randrange(999)}" for _ in range(30)), 1))
        else:
            body = " ".join(rnd.choice(prose) + f" That was {rnd.choice(WORDS)} {rnd.choice(WORDS)}." for _ in range(12))
            out.append((body + ("\nSource: https://news.example/a/1" if how == 3 else ""), 0))
    return out


def test_stuffed_pages(spark, rows):
    data = pages(240, 1)
    got = {d for (d,) in rows(stuffing.stuffed(docs(spark, [t for t, _ in data] + [None, "", "#Tag " * 100, "a" * 200_000])))}
    want = {k for k, (_, y) in enumerate(data) if y}
    assert want <= got and not {k for k, (_, y) in enumerate(data) if not y} & got and 242 in got
    assert stuffing.stuffed(docs(spark, [])).count() == 0
    scores = {r.doc_id: r for r in stuffing.score_pages(docs(spark, [t for t, _ in data])).collect()}
    assert scores[1].host_rate > 0.7 and scores[3].host_rate < 0.5 and scores[2].host_rate is None


def test_word_rates_count_all_documents(spark):
    """A small sample for the trees does not change the words' rates, nor does the number of partitions."""
    data = [t for t, _ in pages(240, 1)]
    whole, sampled = stuffing.fit(docs(spark, data).coalesce(1)), stuffing.fit(docs(spark, data).repartition(7), 60)
    assert whole.words.keys() == sampled.words.keys() and {"mask", "council"} <= whole.words.keys()
    assert all(abs(whole.words[w] - sampled.words[w]) < 1e-9 for w in whole.words)
    assert whole.words["mask"] > 1 > -1 > whole.words["council"]
    assert sampled.trees is not None
