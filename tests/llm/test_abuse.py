import random

import numpy as np

from threadloom.llm import abuse

BAD = ["you are a total idiot", "i hope you die alone", "they are vermin and should be removed", "shut your mouth you moron"]
GOOD = ["the chart shows two cases", "my doctor told me to wait a week", "where is the control group", "thanks for the long reply", "my uncle was called an idiot at the clinic"]


def corpus(n, seed, noise=0.05):
    rnd = random.Random(seed)
    texts, y = [], []
    for _ in range(n):
        bad = rnd.random() < 0.3
        parts = [rnd.choice(GOOD) for _ in range(rnd.randrange(1, 4))]
        if bad:
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice(BAD))
        texts.append(". ".join(parts) + ".")
        y.append(int(bad != (rnd.random() < noise)))
    return texts, np.array(y)


def truth(texts):
    return np.array([any(b in t for b in BAD) for t in texts])


def test_learns_sentences_from_documents():
    texts, y = corpus(1500, 1)
    model = abuse.AbuseModel().fit(texts, y)
    held, _ = corpus(400, 2)
    p, worst = model.score(held)
    assert ((p > abuse.THRESHOLD) == truth(held)).mean() > 0.97
    hits = [abuse.sentences(t)[k] for t, k, s in zip(held, worst, p) if s > abuse.THRESHOLD]
    assert np.mean([any(b in h for b in BAD) for h in hits]) > 0.95
    disguised = ["you are a total 1d10t.", "you are a total i d i o t.", "you are a total i​diot.", "you are a total іdіоt.", "YOU ARE A TOTAL IDIOOOOT."]
    assert (model.score(disguised)[0] > abuse.THRESHOLD).all()


def test_odd_texts():
    model = abuse.AbuseModel().fit(*corpus(300, 3))
    texts = ["", "\x00", "...", "😀", "a" * 300_000, "you are a total idiot. " * 3000, "\n\n"]
    p, worst = model.score(texts)
    assert len(p) == len(texts) and p[0] == 0 and np.isfinite(p).all() and p[5] > 0.5
    assert abuse.AbuseModel().score(["x"])[0].tolist() == [0.0]
    assert len(abuse.AbuseModel().fit(["a"], np.array([1])).weights) == 1
    assert abuse.sentences("One. Two\nThree") == ["one.", "two", "three"]


def test_comments_nulls_and_repeats(spark, rows):
    texts, y = corpus(600, 4, 0)
    data = [(f"c{k}", t, "d", "x") for k, t in enumerate(texts)] + [("T1_z", "you are a total idiot", None, "x"), ("z", "[deleted]", "d", "x"), (None, "you are a total idiot", "d", "x"), ("n", None, "d", "x")]
    comments = spark.createDataFrame(data, "comment_id string, body string, source_dataset string, score string")
    labels = spark.createDataFrame([(f"c{k}", "abusive" if v else "clean", None, "a1") for k, v in enumerate(y)] + [("c0", "unclear", "high", "a2"), (None, "clean", "low", "a2")], "comment_id string, manual_label string, manual_confidence string, annotator string")
    scored = abuse.score_comments(comments, labels)
    assert scored.count() == 603
    found = {r[0] for r in abuse.abusive(scored).collect()}
    assert "z" in found and "n" not in found
    assert {r.source_dataset for r in abuse.rates(scored).collect()} == {"d", "unknown"}
    assert abuse.score_comments(comments.limit(0), labels).count() == 0
    assert rows(abuse.abusive(abuse.score_comments(comments, labels.limit(0)))) == set()
