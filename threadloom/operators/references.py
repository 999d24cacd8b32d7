"""Orphan references by dictionary encoding and compressed bitmaps.

1. *Dictionary.* Every key that is referred to or exists gets an integer code. A
   code is (partition, row in partition) of one written table, so 2^15 neighbouring
   codes are a key range, and the table keeps what is known of the key: whether it
   exists, whether anything of it is left, when it appeared.
2. *Bitmaps.* References are set bits in one bitmap per key range and period;
   existing keys, living keys and keys by the month in which they appeared are
   bitmaps of the same ranges. Bits are set within map tasks first; a hot key is
   one bit however many rows refer to it. Kept bitmaps are compressed: a sorted
   16-bit list while few bits are set, deflated bits otherwise.
3. *AND-NOT.* Reference AND-NOT existing gives missing keys, reference AND-NOT
   living gives deleted ones, reference AND-NOT appeared-before-that-month gives those
   that may be late. A range is at most 2^15 bits, so no task holds an unbounded group.
4. *Decode.* Surviving bits are turned back into codes and looked up in the
   encoded references, which gives the single records. Those that may be late are
   then checked by the second, as months alone do not tell before from after.

A key that a third of all rows refer to is one bit of a bitmap; in the two joins that
carry single references its row goes to them in a broadcast (``join_hot``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.keys import plain_id, plain_key
from threadloom.runtime import Scratch, hot_keys, join_hot

#: Bits of a key range: a bitmap holds 2^15 codes in 4,096 bytes.
RANGE_BITS = 15
RANGE = 1 << RANGE_BITS
#: Up to so many set bits a bitmap is kept as a list of 16-bit numbers.
LIST_LIMIT = 1024

# Bodies of comments whose text is gone.
GONE = ("[deleted]", "[removed]")


def pack(bits: bytes) -> bytes:
    """A raw 4,096-byte bitmap in its shorter form."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
    if len(at) <= LIST_LIMIT:
        return b"L" + at.astype("<u2").tobytes()
    return b"Z" + zlib.compress(bits, 1)


def unpack(packed: bytes | None) -> np.ndarray:
    """The raw bytes of a packed bitmap; none means no bit is set."""
    if packed is None:
        return np.zeros(RANGE // 8, np.uint8)
    if packed[:1] == b"Z":
        return np.frombuffer(zlib.decompress(packed[1:]), np.uint8)
    flags = np.zeros(RANGE, np.uint8)
    flags[np.frombuffer(packed[1:], "<u2")] = 1
    return np.packbits(flags, bitorder="little")


@F.pandas_udf(T.BinaryType())
def _pack(raw: pd.Series) -> pd.Series:
    return raw.map(pack)


def bitmaps(df: DataFrame, by: list[str], code: str = "code") -> DataFrame:
    """Packed bitmap of the codes per key range and ``by``; column ``bits``."""
    at = df.select("*", F.shiftright(code, RANGE_BITS).alias("range"), F.col(code).bitwiseAND(RANGE - 1).alias("_pos"))
    raw = at.groupBy("range", *by).agg(F.bitmap_construct_agg("_pos").alias("raw"))
    return raw.select("range", *by, _pack("raw").alias("bits"))


def _survivors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per reference bitmap the codes that survive each AND-NOT."""
    for pdf in batches:
        parts = []
        for r in pdf.itertuples(index=False):
            ref = unpack(r.bits)
            present, alive, before = unpack(r.present), unpack(r.alive), unpack(None)
            for b in r.born if r.born is not None else ():
                if r.period == "unknown" or b["born"] == "unknown" or b["born"] < r.period:
                    before = before | unpack(b["bits"])
            missing = ref & ~present
            gone = ref & ~alive & ~missing
            late = ref & present & ~before
            for what, bits in (("missing", missing), ("deleted", gone), ("late", late)):
                at = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
                if len(at):
                    parts.append(pd.DataFrame({"code": (int(r.range) << RANGE_BITS) + at.astype("int64"), "period": r.period, "finding": what}))
        if parts:
            yield pd.concat(parts, ignore_index=True)


def _period(created: F.Column) -> F.Column:
    known = created.isNotNull() & ~F.isnan(created)
    return F.when(known, F.date_format(F.timestamp_seconds(created), "yyyy-MM")).otherwise("unknown")


def comment_references(comments: DataFrame) -> DataFrame:
    """One record per comment that refers to something: comment_id, ref_table, key, created, period."""
    c = comments.select(
        plain_id(F.col("comment_id").cast("string")).alias("comment_id"),
        plain_id(F.col("parent_id").cast("string")).alias("key"),
        (F.coalesce(plain_key(F.col("parent_id").cast("string")).startswith("t3_"), F.lit(False)) | F.coalesce(plain_id(F.col("parent_id").cast("string")) == plain_id(F.col("submission_id").cast("string")), F.lit(False))).alias("sub"),
        F.col("created_utc").cast("double").alias("created"),
    ).filter(F.col("comment_id").isNotNull())
    one = c.groupBy("comment_id").agg(F.max("key").alias("key"), F.max(F.when(F.col("key").isNotNull(), F.col("sub"))).alias("sub"), F.max("created").alias("created"))
    return one.filter(F.col("key").isNotNull()).select("comment_id", F.when(F.col("sub"), "submissions").otherwise("comments").alias("ref_table"), "key", "created", _period(F.col("created")).alias("period"))


def orphan_references(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """comment_id, ref_table, finding, period of references to absent, emptied or younger records.

    Ids compare trimmed, lower-cased and without ``t1_``/``t3_``; the rows of one
    id are one record. ``missing``: no row of the table has the id. ``deleted``:
    all rows of a parent comment have a body of [deleted] or [removed].
    ``late``: the parent's created_utc is greater, both known.

    Nulls: no reference without a parent id; an unknown time gives the period
    ``unknown`` and is never late; a null body is not deleted. Equal times are
    not late. Empty tables: without comments nothing comes out, without
    submissions every reference to one is missing. Extra columns are not read.
    """
    spark = comments.sparkSession
    scratch = Scratch(spark, "references")
    # Keys of both tables in one column: the table's first letter stands before the id.
    named = lambda kind, key: F.concat(F.substring(kind, 1, 1), F.lit(":"), key)
    refs = scratch.keep(comment_references(comments).withColumn("key", named(F.col("ref_table"), F.col("key"))))
    gone = F.coalesce(plain_key(F.col("body").cast("string")).isin(*GONE), F.lit(False))
    parents = comments.select(named(F.lit("comments"), plain_id(F.col("comment_id").cast("string"))).alias("key"), (~gone).alias("alive"), F.col("created_utc").cast("double").alias("t"), F.lit(True).alias("here")).unionByName(
        submissions.select(named(F.lit("submissions"), plain_id(F.col("submission_id").cast("string"))).alias("key"), F.lit(True).alias("alive"), F.col("created_utc").cast("double").alias("t"), F.lit(True).alias("here"))
    )
    asked = refs.select("key", F.lit(None).cast("boolean").alias("alive"), F.lit(None).cast("double").alias("t"), F.lit(False).alias("here"))
    keyed = parents.filter(F.col("key").isNotNull()).unionByName(asked).groupBy("key").agg(F.max("here").alias("here"), F.max("alive").alias("alive"), F.max("t").alias("t"), F.min("here").alias("_only_here"))
    # Keys to which nothing refers need no code.
    keyed = keyed.filter(~F.col("_only_here")).drop("_only_here")
    # Written before use: a code given by position must not be given anew.
    codes = scratch.keep(keyed.withColumn("code", F.monotonically_increasing_id()))
    at = F.concat_ws("|", "code", "period")
    encoded = join_hot(refs, codes.select("key", "code", F.col("t").alias("parent_t")), "key", hot_keys(refs, "key"))
    encoded = scratch.keep(encoded.select("comment_id", "ref_table", "code", "created", "period", "parent_t", at.alias("at")))

    ref_bits = bitmaps(encoded.select("code", "period"), ["period"])
    here = bitmaps(codes.filter("here").select("code"), []).withColumnRenamed("bits", "present")
    alive = bitmaps(codes.filter("alive").select("code"), []).withColumnRenamed("bits", "alive")
    # Per range one bitmap for each month in which keys appeared: as many as there are months.
    born = bitmaps(codes.filter("here").select("code", _period(F.col("t")).alias("born")), ["born"])
    born = born.groupBy("range").agg(F.collect_list(F.struct("born", "bits")).alias("born"))
    joined = ref_bits.join(here, "range", "left").join(alive, "range", "left").join(born, "range", "left").select("range", "period", "bits", "present", "alive", "born")
    bits = joined.mapInPandas(_survivors, "code long, period string, finding string")
    # One row per key and month, with up to three findings.
    left = bits.groupBy(at.alias("at")).agg(F.collect_set("finding").alias("findings"))
    hot = hot_keys(encoded, "at")
    found = join_hot(encoded, scratch.keep(left) if hot else left, "at", hot).withColumn("finding", F.explode("findings"))
    holds = F.when(F.col("finding") == "deleted", F.col("ref_table") == "comments").when(F.col("finding") == "late", F.col("parent_t") > F.col("created")).otherwise(True)
    return found.filter(holds).select("comment_id", "ref_table", "finding", "period")


def orphan_report(found: DataFrame) -> DataFrame:
    """References per referenced table, month and finding."""
    return found.groupBy("ref_table", "period", "finding").agg(F.count(F.lit(1)).alias("comments"))
