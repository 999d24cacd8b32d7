"""Mixing sources to target weights by a low-discrepancy schedule.

The mixture is a sequence of slots. Slot i belongs to the source in whose share
of [0, 1) the i-th golden-ratio point falls, so that every stretch of the
sequence, not only the whole, has the target shares up to a few slots. The k-th
slot of a source holds its k-th block: the source's documents, shuffled by hash,
end to end, and after each pass shuffled anew, up to the repeats it is allowed;
this line of tokens is cut every ``size`` tokens, through documents where they stand,
so all blocks are equal and the shares are those of the slots. Nothing is drawn, so
a run can be repeated.

The source that is exhausted first bounds the mixture. Blocks are at most
``block_tokens`` long and so small that this source has ``LEAST_BLOCKS`` of them
(if it has as many tokens), and their number is chosen so that its line comes out
even; a tiny source thus makes a small mixture, never an empty one.

Both the places of documents on the line and the ranks of slots are two-level
prefix sums: small tables of slice sums, then windows within slices. A source
with a third of all documents is in as many slices as any other.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.keys import plain_key
from threadloom.runtime import Scratch

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 2048
#: Fewest blocks of the source that is exhausted first.
LEAST_BLOCKS = 32
#: Uses of documents in a slice of a source's line; slices are a power of two, at most 2 ** 20.
SLICE_ROWS = 20_000
GOLDEN = (math.sqrt(5) - 1) / 2
CHUNK = 1 << 16


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with n_tokens in place of the text; a null text has none."""
    path = f"{tokenizers}/{vocabulary}"
    rest = [f for f in df.schema.fields if f.name != text]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path).encode_ordinary
        for pdf in batches:
            n = [len(encode(t)) if isinstance(t, str) else 0 for t in pdf[text]]
            yield pdf.drop(columns=[text]).assign(n_tokens=pd.Series(n, dtype="int64", index=pdf.index))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return df.mapInPandas(count, f"{schema}, n_tokens bigint")


def _line(docs: DataFrame, totals: DataFrame, uses: int) -> DataFrame:
    """Every allowed use of a document with its place on the source's line of tokens; about ``uses`` in all."""
    bits = min(20, max(3, (uses // SLICE_ROWS).bit_length()))
    passes = F.sequence(F.lit(0), F.col("max_repeats").cast("int") - 1)
    used = docs.join(F.broadcast(totals.select("source", "max_repeats")), "source").withColumn("pass", F.explode(passes)).drop("max_repeats")  # one row a source
    used = used.withColumn("_h", F.xxhash64("doc_id", "pass")).withColumn("_slice", F.shiftright("_h", 64 - bits).cast("int"))
    sums = used.groupBy("source", "pass", "_slice").agg(F.sum("n_tokens").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("pass", "_slice").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    within = F.sum("n_tokens").over(Window.partitionBy("source", "pass", "_slice").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = used.withColumn("_upto", within).join(sums, ["source", "pass", "_slice"])
    return placed.select("source", "doc_id", "n_tokens", F.col("pass"), (F.col("_before") + F.col("_upto") - F.col("n_tokens")).alias("start"))


def schedule(spark, weights: list[tuple[str, float]], slots: int) -> DataFrame:
    """slot, source, rank (0, 1, ... within the source) of the golden-ratio sequence."""
    point = F.col("slot").cast("double") * F.lit(GOLDEN)
    point = point - F.floor(point)
    upto, case = 0.0, None
    for name, w in weights[:-1]:
        upto += w
        case = (F.when if case is None else case.when)(point < upto, name)
    source = F.lit(weights[-1][0]) if case is None else case.otherwise(weights[-1][0])
    line = spark.range(slots).select(F.col("id").alias("slot")).select("slot", source.alias("source"), F.floor(F.col("slot") / CHUNK).alias("_chunk"))
    sums = line.groupBy("source", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("source", "_chunk", before.alias("_before"))
    inner = F.row_number().over(Window.partitionBy("source", "_chunk").orderBy("slot")) - 1
    return line.withColumn("_in", inner).join(sums, ["source", "_chunk"]).select("slot", "source", (F.col("_before") + F.col("_in")).alias("rank"))


def _sizes(rows: list, block_tokens: int) -> tuple[int, dict[str, int], list[tuple[str, float]]]:
    """Tokens of a block, blocks of every source, shares; rows: source, tokens, target_share, max_repeats."""
    norm = sum(r["target_share"] for r in rows)
    weights = [(r["source"], r["target_share"] / norm) for r in rows]
    allowed = {r["source"]: r["tokens"] * r["max_repeats"] for r in rows}
    scarce = min(weights, key=lambda sw: (allowed[sw[0]] / sw[1], sw[0]))[0]
    n = min(allowed[scarce], max(LEAST_BLOCKS, -(-allowed[scarce] // block_tokens)))
    size = allowed[scarce] // n
    return size, {s: a // size for s, a in allowed.items()}, weights


def mix(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, tokenizers: str = TOKENIZERS) -> DataFrame:
    """slot, place, source, doc_id, pass, first_token, n_tokens: the mixture in order of (slot, place).

    A row is a document or, where a block ends inside it, a piece of one: its
    ``n_tokens`` tokens from ``first_token`` on. Every slot has the same number
    of tokens. Source names compare trimmed and lower-cased; documents of a
    source without a target, or without a source or id, take no part. Target
    shares are taken relative to their sum. The size is the greatest at which no
    document is used more than max_repeats times (null or less than 1 counts as
    0: the source takes no part), up to one block; a target source without any token takes no part
    either, as the mixture would otherwise be empty, and its share goes to the
    rest in proportion. Repeated texts under several ids are several documents.
    Empty texts have no tokens and are left out. Empty tables give an empty result.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixture")
    goal = targets.select(plain_key(F.col("source").cast("string")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    goal = goal.filter(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1)).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_key(F.col("source").cast("string")).alias("source"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull() & F.col("source").isNotNull())
    goal = scratch.keep(goal.coalesce(1))
    docs = docs.join(F.broadcast(goal.select("source")), "source", "left_semi")  # one row a source
    counted = scratch.keep(token_counts(docs, tokenizers=tokenizers).filter(F.col("n_tokens") > 0))
    totals = scratch.keep(counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")).join(goal, "source"))
    rows = sorted(totals.collect(), key=lambda r: r["source"])  # one row a source
    if not rows:
        return spark.createDataFrame([], "slot bigint, place int, source string, doc_id bigint, pass int, first_token bigint, n_tokens bigint")
    size, blocks, weights = _sizes(rows, block_tokens)
    slots = max(1, int(min(blocks[s] / w for s, w in weights)))
    while slots > 1:
        per = {r["source"]: r["count"] for r in schedule(spark, weights, slots).groupBy("source").count().collect()}
        over = max(per.get(s, 0) - blocks[s] for s, _ in weights)
        if over <= 0:
            break
        slots = max(1, slots - max(1, int(over / max(w for _, w in weights))))
    line = _line(counted, totals, sum(r["documents"] * r["max_repeats"] for r in rows)).withColumn("_end", F.col("start") + F.col("n_tokens"))
    ranks = F.sequence(F.floor(F.col("start") / size), F.floor((F.col("_end") - 1) / size))
    pieces = line.withColumn("rank", F.explode(ranks))
    first, last = F.greatest("start", F.col("rank") * size), F.least("_end", (F.col("rank") + 1) * size)
    pieces = pieces.select("source", "rank", "doc_id", "pass", "start", (first - F.col("start")).alias("first_token"), (last - first).alias("n_tokens"))
    placed = schedule(spark, weights, slots).join(pieces, ["source", "rank"])
    place = F.row_number().over(Window.partitionBy("slot").orderBy("start", "doc_id")) - 1
    return placed.select("slot", place.alias("place"), "source", "doc_id", "pass", "first_token", "n_tokens")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """source, tokens, documents, most_uses, share, target_share: what was reached."""
    per_doc = mixture.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count_distinct("pass").alias("uses"))
    per = per_doc.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    goal = targets.select(plain_key(F.col("source").cast("string")).alias("source"), F.col("target_share").cast("double").alias("target_share"), "max_repeats")
    out = goal.join(per, "source", "left").fillna(0, ["tokens", "documents", "most_uses"])
    return out.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())), F.lit(0.0)), 6))
