"""Abusive, hateful or sexual content by multiple-instance learning.

Labels exist for a part of the comments as wholes; what offends is mostly one
sentence. Each sentence gets a probability from a linear model over its words,
word pairs and word triples; the document's probability is their noisy-or,
1 - prod(1 - p). The model is trained through the noisy-or from document labels
alone, allowing for a share of wrong labels either way, and then tells which
sentence made the score. Words are first brought into one spelling: entities,
invisible characters, look-alike letters, digits for letters, stretched and
spaced-out words.

Training takes a hash sample of at most ``FIT_LABELS`` labelled comments, joined
with their bodies in Spark; scoring is one pass over all comments without a
shuffle, vectorised over whole Arrow batches.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.keys import plain_id, plain_key
from threadloom.llm.words import INVISIBLE
from threadloom.runtime import Scratch, broadcast_if_small

#: Most labelled comments that the model is fitted on.
FIT_LABELS = 16_000
THRESHOLD = 0.45
EPOCHS, BATCH, RATE, DECAY = 15, 512, 0.05, 3e-4
#: Weights of word groups below this are dropped after training.
PRUNE = 0.02
#: Assumed rates of clean comments labelled abusive and of the reverse.
FALSE_ABUSE, FALSE_CLEAN = 0.04, 0.05
#: Unlabelled comments taken as background, and how little their being unlabelled says against abuse.
FIT_BACKGROUND, BACKGROUND_CLEAN = 16_000, 0.6

# Letters of other scripts that look like Latin ones.
ALIKE = str.maketrans("аеорсухіјѕһԁԛԝкмтвнгпАВЕКМНОРСТУХІЈЅαεοριυνκτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ’ʼ`´", "aeopcyxijshdqwkmtbhrnABEKMHOPCTYXIJSaeopiuvktABEZHIKMNOPTYX''''")
# Digits and signs that stand for letters inside words.
LEET = str.maketrans("0134578$@!|", "oieastbsaii")
WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*·,/|]){2,}[^\W_](?![^\W_])")
#: Characters that need work before a text can be compared: not Latin letters, and no plain signs.
ODD = re.compile("[\u00ad\u034f-\u052f\u061c\u1160-\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2019\u02bc\u00b4\ufe00-\ufe0f\ufeff\uff01-\uff5e]")
RUNS = re.compile(r"(.)\1{2,}")
PIECE = re.compile(r"[^\W_]+(?:[*$@!|]+[^\W_]+)*|[.!?…]+$|[\n\x00]|[\U0001F300-\U0001FAFF☀-➿]")
ENDS = frozenset(".!?…\n\x00")


def _unspace(m: re.Match) -> str:
    letters = re.sub(r"[^\w]|_", "", m[0])
    return letters if not letters.isdigit() else m[0]


def one_spelling(text: str) -> str:
    """Entities, invisible characters and look-alikes resolved; lower case."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii() and ODD.search(text):
        text = INVISIBLE.sub("", text).translate(WIDE).translate(ALIKE)
    return text.lower()


def one_word(raw: str) -> str:
    """A token's form in the vocabulary."""
    if raw.isdigit():
        return "0"
    if "*" in raw:
        return raw[0] + "*" + raw[-1]
    if any(c in "0134578$@!|" for c in raw) and any(c.isalpha() for c in raw):
        raw = raw.translate(LEET)
    return RUNS.sub(r"\1", raw)


def raw_tokens(texts: list[str]) -> list[str]:
    """Texts cut at blanks and line ends; the token ``\\x00`` ends a text."""
    spelled = [one_spelling(t).replace("\x00", " ") for t in texts]
    raw = " \x00 ".join(spelled).replace("\n", " \n ").replace("\t", " ").split(" ")
    # Letters spaced out: three or more single letters in a row are one word.
    single = np.fromiter(map(len, raw), np.int64, len(raw)) == 1
    runs = np.flatnonzero(single[:-2] & single[1:-1] & single[2:])
    if len(runs):
        out, last = [], 0
        for i in runs.tolist():
            if i < last or not all(raw[i + k].isalpha() for k in range(3)):
                continue
            end = i + 3
            while end < len(raw) and len(raw[end]) == 1 and raw[end].isalpha():
                end += 1
            out += raw[last:i]
            out.append("".join(raw[i:end]))
            last = end
        raw = out + raw[last:]
    return raw


class _Memo(dict):
    """Token as written to a number; ``ids`` and ``span`` hold what it stands for."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known
        self.parts: list[list[int]] = []

    def __missing__(self, raw: str) -> int:
        joined = SPACED.sub(_unspace, raw) if len(raw) > 4 else raw
        ids = []
        for piece in PIECE.findall(joined):
            ids.append((-2 if piece == "\x00" else -1) if piece[0] in ENDS else self.known.get(one_word(piece), 0))
        self.parts.append(ids)
        self[raw] = k = len(self.parts) - 1
        return k

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths, starts and the ids of all parts end to end."""
        n = np.fromiter(map(len, self.parts), np.int64, len(self.parts))
        flat = np.fromiter((x for p in self.parts for x in p), np.int64, int(n.sum()))
        return n, np.cumsum(n) - n, flat


def _ids(raw: list[str], memo: _Memo) -> np.ndarray:
    """Word ids; 0 unknown, -1 the end of a sentence, -2 the end of a document."""
    if len(memo) > 500_000:
        memo.clear()
        memo.parts = []
    codes = np.fromiter(map(memo.__getitem__, raw), np.int64, len(raw))
    n, start, flat = memo.tables()
    length = n[codes]
    ends = np.cumsum(length)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[codes] - (ends - length), length)
    return flat[at]


def _layout(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Words alone, their sentence numbers, each sentence's document, and the number of documents."""
    ends = ids < 0
    sentence = np.cumsum(ends)
    doc = np.cumsum(ids == -2)
    words = ~ends
    sent = sentence[words]
    used, sent = np.unique(sent, return_inverse=True)
    doc_of = np.zeros(len(used), np.int64)
    doc_of[sent] = doc[words]
    return ids[words], sent, doc_of, int(doc[-1]) + 1 if len(ids) else 1


class AbuseModel:
    """Sentence model over unigrams, bigrams and trigrams of a closed vocabulary."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.keys = [np.zeros(0, np.int64)] * 2
        self.weights = np.zeros(1)
        self.bias = -4.0
        self._memo = _Memo(self.words)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_memo"}

    def __setstate__(self, state):
        self.__dict__ = state | {"_memo": _Memo(state["words"])}

    # Features are numbered: words, then bigrams, then trigrams; 0 is none.
    def _features(self, ids: np.ndarray, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = np.flatnonzero(ids > 0)
        feats, at = [ids[known]], [sent[known]]
        base = v = len(self.words) + 1
        where, key = known, ids[known]
        for k, table in enumerate(self.keys, 1):
            if not len(table):
                break
            # A kept n-gram begins with a kept shorter one: only hits go on.
            ok = where + k < len(ids)
            where, key = where[ok], key[ok]
            nxt = ids[where + k]
            ok = (nxt > 0) & (sent[where + k] == sent[where])
            where, key = where[ok], key[ok] * v + nxt[ok]
            pos = np.searchsorted(table, key)
            pos[pos == len(table)] = 0
            hit = table[pos] == key
            where, key = where[hit], key[hit]
            feats.append(base + pos[hit])
            at.append(sent[where])
            base += len(table)
        return np.concatenate(feats), np.concatenate(at)

    def fit(self, texts: list[str], labels: np.ndarray, background: list[str] = (), seed: int = 11) -> AbuseModel:
        """Learn from labelled texts, and from ``background``: texts without a label, most of them clean."""
        if not texts or labels.min() == labels.max():
            return self
        rest = len(background)
        texts = [*texts, *background]
        labels = np.concatenate([labels, np.zeros(rest, int)])
        false_abuse = np.where(np.arange(len(texts)) < len(texts) - rest, FALSE_ABUSE, 0.0)
        false_clean = np.where(np.arange(len(texts)) < len(texts) - rest, FALSE_CLEAN, BACKGROUND_CLEAN)
        pieces = raw_tokens(texts)
        counts: Counter = Counter()
        for raw, c in Counter(pieces).items():
            for piece in PIECE.findall(SPACED.sub(_unspace, raw)):
                if piece[0] not in ENDS:
                    counts[one_word(piece)] += c
        self.words = {w: i + 1 for i, w in enumerate(sorted(w for w, c in counts.items() if c >= 2))}
        self._memo = _Memo(self.words)
        ids, sent, doc_of, n = _layout(_ids(pieces, self._memo))
        v = len(self.words) + 1
        key = ids
        for k in (1, 2):
            key = key[:-1] * v + ids[k:]
            ok = sent[:-k] == sent[k:]
            for j in range(k + 1):
                ok = ok & (ids[j : len(ids) - k + j] > 0)
            uniq, c = np.unique(key[ok], return_counts=True)
            self.keys[k - 1] = uniq[c >= 2]
        feats, at = self._features(ids, sent)
        size = v + sum(map(len, self.keys))
        order = np.argsort(at, kind="stable")
        feats, at = feats[order], at[order]
        start = np.searchsorted(at, np.arange(len(doc_of) + 1))
        first = np.searchsorted(doc_of, np.arange(n + 1))
        w, b = np.zeros(size), self.bias
        g2, gb2 = np.full(size, 1e-6), 1e-6
        rng = np.random.default_rng(seed)
        y = labels.astype(float)
        for epoch in range(EPOCHS):
            for part in np.array_split(rng.permutation(n), max(1, n // BATCH)):
                rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in part]) if len(part) else np.zeros(0, int)
                if not len(rows):
                    continue
                owner = np.repeat(np.arange(len(part)), first[part + 1] - first[part])
                spans = start[rows + 1] - start[rows]
                take = np.concatenate([np.arange(start[r], start[r + 1]) for r in rows])
                f, s = feats[take], np.repeat(np.arange(len(rows)), spans)
                z = np.clip(np.bincount(s, w[f], len(rows)) + b, -30, 30)
                q = 1 / (1 + np.exp(-z))
                miss = np.bincount(owner, np.log1p(-np.minimum(q, 1 - 1e-9)), len(part))
                p = -np.expm1(miss)
                slope = 1 - false_abuse[part] - false_clean[part]
                seen = np.clip(false_abuse[part] + slope * p, 1e-9, 1 - 1e-9)
                dp = (seen - y[part]) / (seen * (1 - seen)) * slope
                # d p / d z of one sentence: (1 - p) / (1 - q) * q (1 - q)
                dz = dp[owner] * (1 - p[owner]) * q
                grad = np.bincount(f, dz[s], size)
                touched = np.flatnonzero(grad)
                grad = grad[touched] + DECAY * len(part) * w[touched]
                g2[touched] += grad**2
                w[touched] -= RATE * 4 * grad / np.sqrt(g2[touched])
                gb = dz.sum()
                gb2 += gb**2
                b -= RATE * gb / np.sqrt(gb2)
        self.weights, self.bias = w, b
        self._prune(v)
        return self

    def _prune(self, v: int) -> None:
        """Drop trigrams without weight, and bigrams without weight that begin no kept trigram."""
        two, three = self.keys
        w1, w2, w3 = self.weights[:v], self.weights[v : v + len(two)], self.weights[v + len(two) :]
        keep3 = np.abs(w3) >= PRUNE
        keep2 = (np.abs(w2) >= PRUNE) | np.isin(two, three[keep3] // v)
        self.keys = [two[keep2], three[keep3]]
        self.weights = np.concatenate([w1, w2[keep2], w3[keep3]])

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text its probability and the number of its worst sentence among those with words."""
        n = len(texts)
        if not n:
            return np.zeros(0), np.zeros(0, np.int64)
        ids, sent, doc_of, _ = _layout(_ids(raw_tokens(texts), self._memo))
        if not len(ids) or len(self.weights) == 1:
            return np.zeros(n), np.zeros(n, np.int64)
        f, s = self._features(ids, sent)
        z = np.clip(np.bincount(s, self.weights[f], len(doc_of)) + self.bias, -30, 30)
        q = 1 / (1 + np.exp(-z))
        p = -np.expm1(np.bincount(doc_of, np.log1p(-np.minimum(q, 1 - 1e-9)), n))
        # The first sentence with the highest score of each document.
        order = np.lexsort((np.arange(len(q)), -q, doc_of))
        docs, head = np.unique(doc_of[order], return_index=True)
        start = np.searchsorted(doc_of, docs)
        worst = np.zeros(n, np.int64)
        worst[docs] = order[head] - start
        return p, worst


def sentences(text: str) -> list[str]:
    """The sentences with words, as scoring numbers them (in one spelling)."""
    out: list[str] = []
    part: list[str] = []
    words = False
    for raw in [*raw_tokens([text]), "\n"]:
        kinds = [p[0] in ENDS for p in PIECE.findall(SPACED.sub(_unspace, raw))]
        words |= not all(kinds)
        part.append(raw.strip())
        if any(kinds):
            if words:
                out.append(" ".join(p for p in part if p))
            part, words = [], False
    return out


def labelled_bodies(comments: DataFrame, labels: DataFrame, limit: int = FIT_LABELS) -> DataFrame:
    """body, label of a hash sample of at most about ``limit`` labelled comments.

    Several labels of a comment are averaged, surer ones weighing more; unclear
    labels and ties are left out.
    """
    weight = F.when(plain_key(F.col("manual_confidence").cast("string")) == "high", 1.0).when(plain_key(F.col("manual_confidence").cast("string")) == "low", 0.4).otherwise(0.7)
    kind = plain_key(F.col("manual_label").cast("string"))
    votes = labels.select(plain_id(F.col("comment_id").cast("string")).alias("comment_id"), F.when(kind == "abusive", weight).when(kind == "clean", -weight).alias("vote"))
    votes = votes.filter(F.col("vote").isNotNull() & F.col("comment_id").isNotNull()).groupBy("comment_id").agg(F.sum("vote").alias("vote")).filter(F.abs("vote") > 1e-6)
    n = votes.count()
    keep = min(1.0, limit / n) if n else 1.0
    votes = votes.filter(F.pmod(F.xxhash64("comment_id"), F.lit(1 << 30)) < int(keep * (1 << 30)))
    bodies = comments.select(plain_id(F.col("comment_id").cast("string")).alias("comment_id"), F.col("body").cast("string").alias("body")).filter(F.col("body").isNotNull() & ~F.lower(F.trim("body")).isin("[deleted]", "[removed]"))
    hit = bodies.join(broadcast_if_small(votes), "comment_id")
    return hit.groupBy("comment_id").agg(F.max("body").alias("body"), F.max((F.col("vote") > 0).cast("int")).alias("label"))


def fit(comments: DataFrame, labels: DataFrame, limit: int = FIT_LABELS, background: int = FIT_BACKGROUND) -> AbuseModel:
    """A model from at most about ``limit`` labelled comments and ``background`` others (hash samples)."""
    rows = labelled_bodies(comments, labels, limit).orderBy("comment_id").limit(2 * limit).collect()
    if not rows:
        return AbuseModel()
    n = comments.count()
    share = int(min(1.0, background / max(n, 1)) * (1 << 30))
    others = comments.select(F.col("comment_id").cast("string").alias("id"), F.col("body").cast("string").alias("body")).filter(F.col("body").isNotNull() & (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < share))
    taken = others.orderBy("id", "body").limit(2 * background).collect()
    return AbuseModel().fit([r["body"] for r in rows], np.array([r["label"] for r in rows], int), [r["body"] for r in taken])


def _scorer(shared, locate: bool):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: AbuseModel = shared.value
        for pdf in batches:
            texts = pdf["body"].tolist()
            p, worst = model.score(texts)
            out = {"comment_id": pdf["comment_id"], "source_dataset": pdf["source_dataset"], "score": p}
            if locate:
                out["sentence"] = [sentences(t)[k] if s > THRESHOLD else None for t, s, k in zip(texts, p, worst)]
            yield pd.DataFrame(out)

    return score


def score_comments(comments: DataFrame, labels: DataFrame, model: AbuseModel | None = None, locate: bool = True) -> DataFrame:
    """One row per row of ``comments`` with an id: comment_id, source_dataset, score[, sentence].

    Ids are trimmed, lower-cased and without ``t1_``. A null, empty or removed
    body scores 0. ``sentence`` is the worst sentence of a comment above the
    threshold, in the spelling the model sees. Without labels of both kinds every
    score is 0. Repeated rows are scored each; extra columns are not read.
    """
    model = model or fit(comments, labels)
    spark = comments.sparkSession
    rows = comments.select(plain_id(F.col("comment_id").cast("string")).alias("comment_id"), plain_key(F.col("source_dataset").cast("string")).alias("source_dataset"), F.coalesce(F.col("body").cast("string"), F.lit("")).alias("body")).filter(F.col("comment_id").isNotNull())
    schema = "comment_id string, source_dataset string, score double" + ", sentence string" * locate
    return rows.mapInPandas(_scorer(spark.sparkContext.broadcast(model), locate), schema)


def abusive(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """comment_id of comments with a row above the threshold."""
    return scored.filter(F.col("score") > threshold).select("comment_id").distinct()


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: comments, those above the threshold, their rate, and the mean score."""
    scratch = Scratch(scored.sparkSession, "abuse")
    one = scored.groupBy(F.coalesce("source_dataset", F.lit("unknown")).alias("source_dataset"), "comment_id").agg(F.max("score").alias("score"))
    one = scratch.keep(one)
    per = one.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("comments"), F.count_if(F.col("score") > threshold).alias("to_review"), F.avg("score").alias("mean_score"))
    return per.withColumn("rate", F.col("to_review") / F.col("comments"))
