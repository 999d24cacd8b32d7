"""Session settings, tables kept between stages, size-checked broadcasts, and joins and orders that hot keys don't hold up."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size of a side that may be broadcast on request.
BROADCAST_BYTES = 64 * 1024 * 1024
#: A table of at most this estimated size is within what one task can hold: no key of it needs splitting.
TASK_BYTES = 64 * 1024 * 1024
#: A key with more than this share of the rows is hot, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.005
#: The same for keys whose rows a window would hold together, which adaptive execution can't split.
WINDOW_SHARE = 0.0005
#: Rows of the sample in which hot keys are looked for, and slices that a hot key's rows are cut into.
HOT_SAMPLE, HOT_SLICES = 200_000, 64


def session(app: str = "threadloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use.

    On a cluster the session comes from the submitter; nothing here depends on
    being the one who built it.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Only where the setting is absent (tests, a single machine) a temporary
    folder of the process takes its place; the session's setting is left alone.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/threadloom-{os.getpid()}"


class Scratch:
    """Tables written to the shared folder in order to cut a long lineage.

    A table survives the loss of executors, unlike a cached or locally
    checkpointed one. ``drop`` removes a table that no later stage reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write the frame and return a frame that reads what was written."""
        return self.counted(df)[0]

    def counted(self, df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        """As ``keep``, with counts of its rows, read back from what was written.

        Not by an ``Observation``: a session that made one can no longer be
        serialised, which the closures of some ML transformers need.
        """
        self._count += 1
        path = f"{self.root}/{self._count}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path  # type: ignore[attr-defined]
        if not counts:
            return kept, {}
        row = kept.agg(*[F.count_if(c).alias(n) for n, c in counts.items()]).first()
        return kept, {n: int(row[n]) for n in counts}

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path is None:
            return
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size if isinstance(size, int) else size.toString())


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where the estimated size is within the limit.

    Beyond it the frame is returned without a hint: the join is then planned as
    a shuffled join, which needs no memory for a whole side.
    """
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, least_bytes: int | None = None) -> list:
    """Values of ``key`` that more than ``share`` of the rows have; at most 2 / share of them.

    They are looked for in a sample of about ``HOT_SAMPLE`` rows: what is found
    decides how rows travel and never what comes out. A table of at most
    ``least_bytes`` (``TASK_BYTES``) has none worth splitting. ``df`` should be a written table,
    as it is read here.
    """
    if estimated_bytes(df) <= (TASK_BYTES if least_bytes is None else least_bytes):
        return []
    rows = df.select(key).filter(F.col(key).isNotNull())
    total = rows.count()
    f = min(1.0, HOT_SAMPLE / max(total, 1))
    part = rows if f >= 1.0 else rows.sample(withReplacement=False, fraction=f, seed=17)
    n = F.count(F.lit(1))
    return [r[0] for r in part.groupBy(key).agg(n.alias("n")).filter(F.col("n") > share * f * total).orderBy(F.desc("n"), key).limit(int(2 / share)).collect()]


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """``left.join(right, key, how)`` (inner, left, left_semi, left_anti) with a ``right`` of unique keys.

    Rows of hot keys stay where they are and meet those keys' rows of ``right``,
    at most one for each, in a broadcast; all others are joined as usual.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(right.filter(F.col(key).isin(hot)))  # at most len(hot) rows
    return left.filter(is_hot).join(few, key, how).unionByName(left.filter(~is_hot).join(right, key, how))


def cut_hot(df: DataFrame, key: str, order: list[str], source: DataFrame | None = None, share: float = WINDOW_SHARE, least_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """Adds ``_slice``: consecutive stretches of the rows of a key by ``order``, several for hot keys, and whether there are any.

    A window by (key, _slice) then holds a bounded share of the rows, whatever
    times they have. The bounds of the slices are quantiles of a hot key's rows in a sample
    of bounded size, at most ``HOT_SLICES`` a key; they move no result. ``source``:
    a written table with the same columns that hot keys and bounds are taken from, if ``df`` is none.
    """
    source = (df if source is None else source).select(key, *order)
    hot = hot_keys(source, key, share, least_bytes)
    if not hot:
        return df.withColumn("_slice", F.lit(0)), False
    spark = df.sparkSession
    names = spark.createDataFrame([(h,) for h in hot], source.select(key).schema)
    rows = source.join(F.broadcast(names), key, "left_semi")  # at most 2 / share rows
    f = min(1.0, HOT_SAMPLE / max(rows.count(), 1))
    part = rows if f >= 1.0 else rows.sample(withReplacement=False, fraction=f, seed=19)
    # A sample of about HOT_SAMPLE rows: the lists together are no longer than that.
    lists = part.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_all"))
    step = F.greatest(F.lit(1), F.floor(F.size("_all") / HOT_SLICES)).cast("int")
    cuts = lists.select(key, F.transform(F.sequence(F.lit(0), F.size("_all") - 1, step), lambda i: F.get("_all", i)).alias("_cuts"))
    bounds = spark.createDataFrame(cuts.collect(), cuts.schema)
    at = df.join(F.broadcast(bounds), key, "left")  # one row a hot key
    mine = F.struct(*order)
    return at.withColumn("_slice", F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c <= mine)))).drop("_cuts"), True
