"""Remote services that give out numbered items, as tables and as streams (Python data sources).

A client names the newest item's number and fetches the items of a span of numbers.  A table reads spans of ``page`` numbers as
partitions, in parallel; a stream's offset is the number of the last item that it has given out, so a restart goes on behind it and a
broken batch fetches the same spans again.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class Client(Protocol):
    """Has to be the same on all executors (it is pickled), and has to give the same items for a span each time."""

    def newest(self) -> int:
        """The highest number that there is, 0 if there is none; items up to it don't change any more."""

    def fetch(self, after: int, upto: int) -> Iterator[tuple]:
        """The items with numbers behind ``after``, up to ``upto``."""


@dataclass
class HttpClient:
    """A JSON service: ``GET url/newest`` is a number, ``GET url/items?after=A&upto=B`` a list of objects."""

    url: str
    columns: Sequence[str]
    timeout: float = 30.0
    tries: int = 4

    def _get(self, path: str):
        for left in reversed(range(self.tries)):
            try:
                with urllib.request.urlopen(f"{self.url.rstrip('/')}/{path}", timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if not left or e.code < 500 and e.code != 429:  # what the caller did wrong stays wrong
                    raise
            except (urllib.error.URLError, TimeoutError):
                if not left:
                    raise
            time.sleep(0.2 * 2 ** (self.tries - 1 - left))

    def newest(self) -> int:
        return int(self._get("newest"))

    def fetch(self, after: int, upto: int) -> Iterator[tuple]:
        for item in self._get(f"items?after={after}&upto={upto}"):
            yield tuple(item.get(c) for c in self.columns)


@dataclass
class ParquetClient:
    """A folder or file of Parquet as a service: its rows are the items, a column of whole numbers from 1 their numbers."""

    path: str
    number: str
    columns: Sequence[str]

    def _items(self) -> ds.Dataset:
        if "://" in self.path or self.path.startswith("file:"):
            system, path = fs.FileSystem.from_uri(self.path)
            return ds.dataset(path, filesystem=system)
        return ds.dataset(self.path)

    def newest(self) -> int:
        return max((max((n for n in batch.column(0).to_pylist() if n is not None), default=0) for batch in self._items().to_batches(columns=[self.number])), default=0)

    def fetch(self, after: int, upto: int) -> Iterator[tuple]:
        number = ds.field(self.number)
        for batch in self._items().to_batches(columns=list(self.columns), filter=(number > after) & (number <= upto)):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


@dataclass
class Span(InputPartition):
    after: int
    upto: int


def _spans(after: int, upto: int, page: int) -> list[Span]:
    return [Span(n, min(n + page, upto)) for n in range(after, upto, page)]


def register(spark: SparkSession, name: str, client: Client, schema: str) -> None:
    """Makes a service known as a format: ``spark.read.format(name)`` and ``spark.readStream.format(name)``.

    Options: ``page``, how many numbers a request and a partition span (1,000); ``after``, the number behind which to begin (0); and for
    tables ``pages``, the most pages to read (all, if not given).
    """

    class Table(DataSourceReader):
        def __init__(self, options: dict):
            self.page, self.after, self.pages = int(options.get("page", 1000)), int(options.get("after", 0)), options.get("pages")

        def partitions(self):
            spans = _spans(self.after, client.newest(), self.page)
            return spans if self.pages is None else spans[: int(self.pages)]

        def read(self, span):
            return client.fetch(span.after, span.upto) if span is not None else iter(())

    class Stream(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.page, self.after = int(options.get("page", 1000)), int(options.get("after", 0))

        def initialOffset(self):
            return {"number": self.after}

        def latestOffset(self, *_):
            return {"number": max(self.after, client.newest())}

        def partitions(self, start, end):
            return _spans(start["number"], end["number"], self.page)

        def read(self, span):
            return client.fetch(span.after, span.upto)

    class Service(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Table(self.options)

        def streamReader(self, schema):
            return Stream(self.options)

    spark.dataSource.register(Service)
