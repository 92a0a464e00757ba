"""A store behind HTTP as a Spark source: ``spark.read.format("sparql")``, a query per partition."""

from __future__ import annotations

import json
import sys
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch(endpoint: str, query: str, timeout: float = 600.0) -> list[dict[str, str]]:
    """The bindings of a query as rows; an answer other than 200 raises with its text."""
    url = f"{endpoint}?{urllib.parse.urlencode({'query': query, 'format': 'application/sparql-results+json'})}"
    request = urllib.request.Request(url, headers={"Accept": "application/sparql-results+json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            found = json.load(answer)
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"{endpoint} answered {e.code}: {e.read().decode(errors='replace')[:500]}") from e
    return [{k: v["value"] for k, v in row.items()} for row in found["results"]["bindings"]]


class _Page(InputPartition):
    def __init__(self, query: str):
        super().__init__(0)
        self.query = query


class _Reader(DataSourceReader):
    def __init__(self, columns: list[str], options):
        self.columns, self.endpoint, self.query = columns, options["endpoint"], options["query"]
        self.page, self.pages = int(options.get("page", 0)), int(options.get("pages", 1))

    def partitions(self) -> list[InputPartition]:
        if not self.page:
            return [_Page(self.query)]
        return [_Page(f"{self.query} LIMIT {self.page} OFFSET {i * self.page}") for i in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in fetch(self.endpoint, partition.query):
            yield tuple(row.get(c) for c in self.columns)


class SparqlSource(DataSource):
    """Options: endpoint, query, and page with pages to read an ordered query in parallel. All columns are strings."""

    @classmethod
    def name(cls) -> str:
        return "sparql"

    def schema(self) -> str:
        return "s string, p string, o string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema.fieldNames(), self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SparqlSource)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
