"""Posts from a pluggable connector, as a Spark data source.

    spark.dataSource.register(PostSource)
    spark.read.format("posts").option("provider", "package.module:factory").option("queries", "one\ntwo").load()

Each query is a partition, so connectors are asked from executors, side by side.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from importlib import import_module
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = ("id", "account", "url", "postedAt", "text")


class PostProvider(Protocol):
    """A connector: posts are mappings with the five fields."""

    def search_posts(self, query: str) -> Iterable[dict]: ...

    def get_post(self, post_id: str) -> dict | None: ...


class _Query(InputPartition):
    def __init__(self, number: int, query: str, single: bool):
        self.number, self.query, self.single = number, query, single


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.factory = options.get("provider", "")
        if ":" not in self.factory:
            raise ValueError("option provider must be module:factory")
        self.parts = [_Query(i, q, False) for i, q in enumerate((options.get("queries") or "").split("\n")) if q.strip()]
        self.parts += [_Query(len(self.parts) + i, q, True) for i, q in enumerate((options.get("ids") or "").split("\n")) if q.strip()]
        if not self.parts:
            raise ValueError("give option queries or ids, one a line")

    def partitions(self) -> list[InputPartition]:
        return self.parts

    def read(self, partition: _Query) -> Iterator[tuple]:
        module, name = self.factory.split(":", 1)
        provider: PostProvider = getattr(import_module(module), name)()
        found = [provider.get_post(partition.query)] if partition.single else provider.search_posts(partition.query)
        for i, post in enumerate(p for p in found if p is not None):
            yield ((partition.number << 40) + i, *(v if isinstance(v := post.get(f), str) else None for f in FIELDS))


class PostSource(DataSource):
    """Raw posts `(ord, id, account, url, postedAt, text)`; values that are no strings are null, for validation to tell."""

    @classmethod
    def name(cls) -> str:
        return "posts"

    def schema(self) -> str:
        return "ord long, id string, account string, url string, postedAt string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
