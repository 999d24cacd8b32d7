"""Schemas of the project's files."""

from __future__ import annotations

from pyspark.sql import types as T

STRING = T.StringType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


COMMENTS = struct(
    comment_id=STRING, created_utc=T.DoubleType(), author=STRING, body=STRING, submission_id=STRING, parent_id=STRING, parent_author=STRING, level=T.LongType(),
    subreddit=STRING, submission_author=STRING, submission_title=STRING, candidate_correction=T.BooleanType(), source_dataset=STRING,
)
SUBMISSIONS = struct(submission_id=STRING, subreddit=STRING, author=STRING, title=STRING, url=STRING, created_utc=T.DoubleType(), original_submission=STRING, original_subreddit=STRING, source_dataset=STRING)
CLAIMS = struct(claim_id=STRING, claim=STRING, queries=T.ArrayType(STRING), fact_check_sources=T.ArrayType(STRING))
ARCHIVE_COMMENTS = struct(id=STRING, name=STRING, link_id=STRING, parent_id=STRING, subreddit=STRING, author=STRING, body=STRING, score=T.LongType(), created_utc=T.DoubleType(), permalink=STRING)
ARCHIVE_SUBMISSIONS = struct(id=STRING, name=STRING, subreddit=STRING, author=STRING, title=STRING, selftext=STRING, score=T.LongType(), num_comments=T.LongType(), created_utc=T.DoubleType(), permalink=STRING, url=STRING)
