"""An optional HTTP source of search results, one partition a query; off unless registered."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class SearchSource(DataSource):
    """``spark.dataSource.register(SearchSource)``, then ``format("thread_search")`` with options
    ``endpoint``, ``queries`` (separated by line ends), ``limit`` (at most 100), ``pause`` and ``token``."""

    @classmethod
    def name(cls) -> str:
        return "thread_search"

    def schema(self) -> str:
        return "query string, id string, name string, subreddit string, author string, title string, created_utc double, permalink string, url string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Query(InputPartition):
    def __init__(self, query: str):
        self.query = query


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_Query(q) for q in self.options.get("queries", "").split("\n") if q.strip()]

    def read(self, partition: _Query) -> Iterator[tuple]:
        limit = min(100, int(self.options.get("limit", 25)))
        url = f"{self.options['endpoint']}?{urllib.parse.urlencode({'q': partition.query, 'limit': limit, 'raw_json': 1})}"
        head = {"User-Agent": self.options.get("agent", "threadloom")}
        if self.options.get("token"):
            head["Authorization"] = f"bearer {self.options['token']}"
        with urllib.request.urlopen(urllib.request.Request(url, headers=head), timeout=30) as answer:
            found = json.load(answer)
        time.sleep(float(self.options.get("pause", 1.0)))
        for child in found.get("data", {}).get("children", []):
            d = child.get("data", {})
            yield (partition.query, d.get("id"), d.get("name"), d.get("subreddit"), d.get("author"), d.get("title"), float(d.get("created_utc") or 0), d.get("permalink"), d.get("url"))
