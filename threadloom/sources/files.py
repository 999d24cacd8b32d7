"""Readers and writers of JSON lines, archives, CSV and small documents."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import keys, lexicon, text


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict: a line that is no JSON of the schema fails the read; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_archive(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Tolerant: (rows, lines that were no JSON). Plain, gzip, bzip2 and, where Hadoop has the codec, zstandard."""
    if path.endswith(".zst"):
        lines = _zstd_lines(spark, path)
    else:
        lines = spark.read.text(path)
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.filter(F.trim("value") != "").select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    bad = F.col("r._bad").isNotNull() | F.col("r").isNull()
    return parsed.filter(~bad).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields]), parsed.filter(bad).select("value")


def _zstd_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of zstandard files, one task a file, decoded as a stream."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import zstandard

        for pdf in batches:
            for name in pdf["path"]:
                local = name.removeprefix("file:")
                local = "/" + local.lstrip("/")
                part: list[str] = []
                with open(local, "rb") as raw:
                    for line in io.TextIOWrapper(zstandard.ZstdDecompressor(max_window_size=2**31).stream_reader(raw), encoding="utf-8", errors="replace"):
                        part.append(line.rstrip("\n"))
                        if len(part) >= 5000:
                            yield pd.DataFrame({"value": part})
                            part = []
                yield pd.DataFrame({"value": part})

    files = spark.read.format("binaryFile").load(path).select("path")
    n = max(1, files.count())
    return files.repartition(n).mapInPandas(decode, "value string")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """With a schema typed, empty cells null; without one all strings, empty cells as the empty string."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    if schema is not None:
        return reader.option("nullValue", "").schema(schema).csv(path)
    df = reader.option("inferSchema", False).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An array of objects in one document."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes, kind of the files below a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return f.select("path", F.col("length").alias("bytes"), F.lower(F.element_at(F.split("path", r"\."), -1)).alias("kind"))


def write_jsonl(df: DataFrame, path: str) -> int:
    """Sorted keys, nulls written; returns the number of rows."""
    out = df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return df.sparkSession.read.text(path).count()


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, strict: bool = False) -> None:
    """Header and the listed columns in order; others are dropped, or refused if ``strict``."""
    columns = columns or df.columns
    if strict and set(df.columns) - set(columns):
        raise ValueError(f"columns not listed: {sorted(set(df.columns) - set(columns))}")
    df.select(*[F.col(f"`{c}`") for c in columns]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_summary(path: str, summary: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(summary, ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")


def write_report(path: str, title: str, summary: dict) -> None:
    """A short text report, counts with thousands separators."""
    show = lambda v: f"{v:,}" if isinstance(v, int) else f"{v:.4f}" if isinstance(v, float) else str(v)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(f"# {title}\n\n" + "".join(f"- {k}: {show(v)}\n" for k, v in summary.items()), encoding="utf-8")


class Run:
    """A run's folder with ``tables`` and ``metrics`` and a summary at its end."""

    def __init__(self, folder: str, *parts: str):
        self.folder = folder
        for part in ("tables", "metrics", *parts):
            os.makedirs(f"{folder}/{part}", exist_ok=True)
        self.summary: dict = {}

    def table(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/tables/{name}")

    def close(self) -> None:
        write_summary(f"{self.folder}/metrics/run_summary.json", self.summary)


def load_env(path: str) -> dict[str, str]:
    """KEY=VALUE lines of a file; what the environment has already is kept."""
    out: dict[str, str] = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, sep, value = line.strip().partition("=")
        if sep and name and not name.startswith("#"):
            out[name.strip()] = os.environ.get(name.strip(), value.strip().strip("\"'"))
    return out


def standard_comments(raw: DataFrame, dataset: str) -> DataFrame:
    """The raw comment file in the canonical schema, with the candidate flag and the data set's name."""
    c = lambda n: keys.none_if_blank(F.col(n))
    return raw.select(
        c("ID").alias("comment_id"), keys.to_double(F.col("Date_utc")).alias("created_utc"), c("Author").alias("author"), F.col("Body").alias("body"), c("Submission").alias("submission_id"), c("Parent_ID").alias("parent_id"),
        c("Parent_Author").alias("parent_author"), keys.to_long(F.col("Level")).alias("level"), F.lower(c("Subreddit")).alias("subreddit"), c("Submission_Author").alias("submission_author"), F.col("Submission_Title").alias("submission_title"),
        lexicon.candidate(F.col("Body")).alias("candidate_correction"), F.lit(dataset).alias("source_dataset"),
    ).filter(F.col("comment_id").isNotNull())


def standard_archive_comments(raw: DataFrame, site: str) -> DataFrame:
    """Archive comments: full name from prefix and id where absent, thread without prefix, absolute links."""
    return raw.select(
        F.col("id").alias("comment_id"), F.coalesce("name", F.concat(F.lit("t1_"), "id")).alias("comment_fullname"), "parent_id", F.regexp_replace("link_id", "t3_", "").alias("submission_id"), "subreddit", "author", "body", "score", "created_utc",
        text.absolute(F.col("permalink"), site).alias("permalink"),
    ).filter(F.col("comment_id").isNotNull())


@F.udtf(returnType="depth int, comment_id string, parent_id string, author string, body string, created_utc double")
class FlattenReplies:
    """Rows of a nested reply tree (JSON text) in reading order; replies may be an empty string or an object."""

    def eval(self, tree: str):
        stack = [(c, 0) for c in reversed(json.loads(tree) if tree else [])]
        while stack:
            node, depth = stack.pop()
            if node.get("kind") != "t1":
                continue
            d = node.get("data", {})
            yield depth, d.get("id"), d.get("parent_id"), d.get("author"), d.get("body"), d.get("created_utc")
            replies = d.get("replies")
            if isinstance(replies, dict):
                stack += [(c, depth + 1) for c in reversed(replies.get("data", {}).get("children", []))]
