"""Evaluation passages inside documents: size-partitioned MinHash containment search.

Items are cut into query passages of two kinds: every run of ``RUN`` words, which
must be contained whole, and the item itself, of which enough three-word
shingles must be contained to be possible with one word in five replaced.
Passages are partitioned by size. For each size class documents are searched in
windows of matching size, since the containment of a small set in a large one is
hidden from MinHash by the large one's size: for runs the windows have exactly
``RUN`` words, so one minimum decides, and equal windows have equal minima; for
whole items windows are half as long again as the longest item of the class and
overlap by two thirds, and any of ``HASHES`` equal minima makes a candidate.

Document sets are restricted to shingles that occur in any item, which changes no
containment of an item, and nearly empties most documents. Candidates
are verified by exact shingle containment: word for word along the run, or
counting equal words along the diagonals which shared shingles name.

Three-word shingles take the place of five-word ones: with every fifth word
replaced no five-word shingle need be left, while a run of three must be.
Items come to the driver in blocks, bounded in number and in words; documents stay
where they are and need no shuffle. If there are several blocks, one pass over the
documents keeps those that share enough shingles with any item at all, by a sorted
array of all items' shingles (size-checked before it is broadcast), and only
those are searched block by block: the corpus is read once however many items there are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.words import WORD, unmarked, words
from threadloom.runtime import Scratch

SHINGLE = 3
RUN = 12
REPLACED = 0.2
HASHES = 64
#: Documents laid end to end for a search.
DOCUMENTS = 500
#: Items searched at once, and their characters.
BLOCK, BLOCK_CHARS = 2_000, 8_000_000
#: Most shingles of all items that are broadcast for the first pass (8 bytes each).
SIEVE = 20_000_000
#: Bits of a word id inside a shingle: three ids fill 63 bits.
BITS = 21
_MIX = np.random.default_rng(20210607).integers(1, 2**63 - 1, size=(HASHES, 2), dtype=np.int64).astype(np.uint64) | np.uint64(1)


def _hash(x: np.ndarray, k: int) -> np.ndarray:
    a, b = _MIX[k]
    with np.errstate(over="ignore"):
        y = (x.astype(np.uint64) + b) * a
        y ^= y >> np.uint64(29)
        y *= np.uint64(0xBF58476D1CE4E5B9)
        return y ^ (y >> np.uint64(32))


def _shingles(ids: np.ndarray, wide: bool = False) -> np.ndarray:
    """Packed shingle at each place; -1 where a word is unknown."""
    n = len(ids) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    a, b, c = ids[:n], ids[1 : n + 1], ids[2 : n + 2]
    packed = (a << (2 * BITS)) | (b << BITS) | c
    if wide:  # ids of more bits: mixed, and told apart word by word when verified
        packed = (a * 0x1F3D5B79A3C1E507 ^ b * 0x2545F4914F6CDD1D ^ c * 0x369DEA0F31A53F85) & (2**63 - 1)
    return np.where((a > 0) & (b > 0) & (c > 0), packed, -1)


class Index:
    """What a block of items needs to be searched for; bounded by the block, sent to each task."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        #: Items of one or two words, which have no shingle: they are found whole.
        self.short: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text or "")]
            if len(ids) >= SHINGLE:
                self.items.append((item, np.array(ids, np.int64)))
            elif ids:
                self.short.append((item, np.array(ids, np.int64)))
        self.wide = len(self.vocabulary) >= 1 << BITS
        self.universe = np.unique(np.concatenate([_shingles(ids, self.wide) for _, ids in self.items])) if self.items else np.zeros(0, np.int64)
        # Hash values of every shingle that can count, one row a hash function.
        self.hashes = np.stack([_hash(self.universe, j) for j in range(HASHES)]) if len(self.universe) else np.zeros((HASHES, 0), np.uint64)
        # Runs: minimum of a window of RUN words, then its very words, to the places where they occur.
        self.runs: dict[int, dict[bytes, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        # Whole items by size class.
        groups: dict[int, list[int]] = defaultdict(list)
        self.places: list[dict[int, list[int]]] = []
        #: With one word in five replaced an item keeps at least this many places of shingles, and these distinct ones.
        self.keeps: list[int] = []
        self.sets: list[np.ndarray] = []
        width = RUN - SHINGLE + 1
        for k, (_, ids) in enumerate(self.items):
            at = np.searchsorted(self.universe, _shingles(ids, self.wide))
            h = self.hashes[0][at]
            for p in range(len(at) - width + 1):
                self.runs[int(h[p : p + width].min())][ids[p : p + RUN].tobytes()].append((k, p))
            places: dict[int, list[int]] = defaultdict(list)
            for p, x in enumerate(at.tolist()):
                places[x].append(p)
            self.places.append(dict(places))
            self.sets.append(np.unique(at))
            lost = SHINGLE * int(len(ids) * REPLACED) + len(at) - len(places)
            self.keeps.append(max(1, len(at) - lost))
            groups[self.size_class(len(ids))].append(k)
        self.runs = {m: dict(d) for m, d in self.runs.items()}
        # size -> (least shared shingles, item numbers, their minima: one column an item)
        self.classes = {c: (min(self.keeps[k] for k in ks), np.array(ks), np.stack([self.hashes[:, self.sets[k]].min(axis=1) for k in ks], axis=1)) for c, ks in groups.items()}

    @staticmethod
    def size_class(n: int) -> int:
        """Upper bound of the size class: classes grow by a quarter."""
        upper = 8
        while upper < n:
            upper = upper + max(1, upper // 4)
        return upper

    def search(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(place, item number) of the items found in documents laid end to end with a 0 between them; short items are numbered after the others."""
        found = self._short_hits(ids)
        s = _shingles(ids, self.wide)
        if not len(s) or not len(self.universe):
            return found
        pos = np.searchsorted(self.universe, s)
        pos[pos == len(self.universe)] = 0
        inside = (s >= 0) & (self.universe[pos] == s)
        upto = np.concatenate([[0], np.cumsum(inside)])
        found |= self._run_hits(ids, pos, upto)
        mark = np.zeros(len(self.universe), bool)
        for size, (least, numbers, minima) in self.classes.items():
            length, step = size + size // 2, max(1, size // 2)
            starts = np.arange(0, len(s), step)
            many = upto[np.minimum(starts + length, len(s))] - upto[starts] >= least
            for start in starts[many].tolist():
                at = start + np.flatnonzero(inside[start : start + length])
                u = np.unique(pos[at])
                own = self.hashes[:, u].min(axis=1)
                mark[:] = False
                mark[u] = True
                for k in numbers[(minima == own[:, None]).any(axis=0)].tolist():
                    # Exact shingle containment first, then word by word.
                    if mark[self.sets[k]].sum() >= self.keeps[k]:
                        found |= {(p, k) for p in self._replaced(ids, pos, at, k)}
        return found

    def name(self, k: int) -> int:
        return self.items[k][0] if k < len(self.items) else self.short[k - len(self.items)][0]

    def _short_hits(self, ids: np.ndarray) -> set[tuple[int, int]]:
        found: set[tuple[int, int]] = set()
        for k, (_, item) in enumerate(self.short, len(self.items)):
            n = len(ids) - len(item) + 1
            if n > 0:
                same = np.logical_and.reduce([ids[j : n + j] == x for j, x in enumerate(item)])
                found |= {(p, k) for p in np.flatnonzero(same).tolist()}
        return found

    def _run_hits(self, ids: np.ndarray, pos: np.ndarray, upto: np.ndarray) -> set[tuple[int, int]]:
        width = RUN - SHINGLE + 1
        if len(pos) < width:
            return set()
        starts = np.flatnonzero(upto[width:] - upto[:-width] == width)
        found: set[tuple[int, int]] = set()
        if len(starts):
            minima = self.hashes[0][pos[starts[:, None] + np.arange(width)]].min(axis=1)
            done: set[tuple[int, int]] = set()
            for p, m in zip(starts.tolist(), minima.tolist()):
                same = self.runs.get(m)
                for k, q in same.get(ids[p : p + RUN].tobytes(), ()) if same else ():
                    if (p - q, k) not in done:
                        done.add((p - q, k))
                        found.add((p, k))
        return found

    def _replaced(self, ids: np.ndarray, pos: np.ndarray, at: np.ndarray, k: int) -> set[int]:
        """Where the item stands along some diagonal with at most one word in five replaced."""
        item, places = self.items[k][1], self.places[k]
        n = len(item)
        out = set()
        for off in {p - q for p, x in zip(at.tolist(), pos[at].tolist()) for q in places.get(x, ())}:
            lo, hi = max(0, off), min(len(ids), off + n)
            # Documents are apart by a 0, which equals no word of an item.
            same = ids[lo:hi] == item[lo - off : hi - off]
            if n - int(same.sum()) <= int(n * REPLACED):
                out.add(lo + int(np.flatnonzero(same)[0]))
        return out


class _Memo(dict):
    """Token as written to a number; ``parts`` holds the ids of its words."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary, self.parts = vocabulary, []

    def __missing__(self, raw: str) -> int:
        self.parts.append([0] if raw == "\x00" else [self.vocabulary.get(w, 0) for w in WORD.findall(raw)])
        self[raw] = k = len(self.parts) - 1
        return k


def _laid_out(texts: list[str], memo: _Memo) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of many texts with a 0 after each, and where each text begins."""
    if len(memo) > 500_000:
        memo.clear()
        memo.parts = []
    raw = " \x00 ".join([unmarked(t).replace("\x00", " ") for t in texts]).lower().split()
    codes = np.fromiter(map(memo.__getitem__, raw), np.int64, len(raw))
    n = np.fromiter(map(len, memo.parts), np.int64, len(memo.parts))
    flat = np.fromiter((x for p in memo.parts for x in p), np.int64, int(n.sum()))
    length = n[codes]
    ends = np.cumsum(length)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat((np.cumsum(n) - n)[codes] - (ends - length), length)
    breaks = codes == memo.get("\x00", -1)
    return flat[at], np.concatenate([[0], ends[breaks]])


def _searcher(shared):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: Index = shared.value
        memo = _Memo(index.vocabulary)
        for pdf in batches:
            pdf = pdf[pdf["text"].notna()]
            docs, hits = [], []
            for lo in range(0, len(pdf), DOCUMENTS):
                part = pdf.iloc[lo : lo + DOCUMENTS]
                ids, begin = _laid_out(part["text"].tolist(), memo)
                found = {(int(np.searchsorted(begin, place, side="right")) - 1, k) for place, k in index.search(ids)}
                own = part["doc_id"].tolist()
                docs += [own[d] for d, _ in found]
                hits += [index.name(k) for _, k in found]
            yield pd.DataFrame({"doc_id": pd.Series(docs, dtype="int64"), "item_id": pd.Series(hits, dtype="int64")})

    return search


class Sieve:
    """The shingles of all items, and how many a document must share to be searched at all."""

    def __init__(self, texts: Iterator[str]):
        self.vocabulary: dict[str, int] = {}
        rows = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(t or "")], np.int64) for t in texts]
        self.wide = len(self.vocabulary) >= 1 << BITS
        parts = [np.unique(_shingles(ids, self.wide)) for ids in rows if len(ids) >= SHINGLE]
        self.shingles = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        #: An item of n words keeps at least so many of its distinct shingles; items without shingles let every document pass.
        self.least = min((max(1, len(_shingles(ids)) - SHINGLE * int(len(ids) * REPLACED) - (len(_shingles(ids)) - len(np.unique(_shingles(ids, self.wide))))) if len(ids) >= SHINGLE else 0 for ids in rows if len(ids)), default=1)

    def keep(self, texts: list[str], memo: _Memo) -> np.ndarray:
        """Which of the texts have that many distinct shingles of the items, or a run of them."""
        ids, begin = _laid_out(texts, memo)
        s = _shingles(ids, self.wide)
        n = len(texts)
        if self.least == 0 or not len(s):
            return np.full(n, self.least == 0)
        pos = np.searchsorted(self.shingles, s)
        pos[pos == len(self.shingles)] = 0
        at = np.flatnonzero((s >= 0) & (self.shingles[pos] == s)) if len(self.shingles) else np.zeros(0, int)
        doc = np.searchsorted(begin, at, side="right") - 1
        pairs = np.unique(np.column_stack([doc, pos[at]]), axis=0)
        runs = np.bincount(doc, minlength=n)[:n] >= RUN - SHINGLE + 1
        return (np.bincount(pairs[:, 0], minlength=n)[:n] >= self.least) | runs


def _sift(shared):
    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sieve: Sieve = shared.value
        memo = _Memo(sieve.vocabulary)
        for pdf in batches:
            for lo in range(0, len(pdf), DOCUMENTS):
                part = pdf.iloc[lo : lo + DOCUMENTS]
                yield part[sieve.keep(part["text"].tolist(), memo)]

    return sift


def find_leaks(documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id: documents that hold ``RUN`` words of an item in a row, or all of it with one word in five replaced.

    Case, punctuation, markup, spacing and invisible characters do not count.
    Nulls: rows without id or text match nothing; an item of one or two words
    is found whole only, one without words never. Repeated rows of documents or items count once. Empty tables
    give an empty result. Extra columns are not read; texts are searched whole.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    wanted = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    out = spark.createDataFrame([], "doc_id bigint, item_id bigint")
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // block), -(-size["chars"] // BLOCK_CHARS))
    if blocks > 1:
        scratch = Scratch(spark, "items")
        wanted = scratch.keep(wanted)
        # No item has more shingles than characters / 2; above the bound every document goes to every block.
        if size["chars"] <= 2 * SIEVE:
            sieve = Sieve(r["text"] for r in wanted.select("text").distinct().toLocalIterator())
            docs = scratch.keep(docs.mapInPandas(_sift(spark.sparkContext.broadcast(sieve)), docs.schema))
    for b in range(blocks):
        part = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        index = Index([(r["item_id"], r["text"]) for r in part.collect()])  # about ``block`` items
        if index.items or index.short:
            out = out.unionByName(docs.mapInPandas(_searcher(spark.sparkContext.broadcast(index)), "doc_id bigint, item_id bigint"))
    return out.distinct()


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """suite, item_id, documents: how many documents hold each leaked item."""
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents")).join(items.select(F.col("item_id").cast("bigint").alias("item_id"), "suite").dropDuplicates(["item_id"]), "item_id").select("suite", "item_id", "documents")
