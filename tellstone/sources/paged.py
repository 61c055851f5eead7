"""A paged JSON service as a data source: each page is a partition that executors fetch for themselves."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, offset: int):
        self.offset = offset


class PagedJson(DataSource):
    """Rows (page, record) of a service that takes ``{offset}`` and ``{length}`` in its address.

    Options: ``url`` (http, https or file), ``rows`` (how many there are), ``length`` (of a page), ``path`` (names,
    by stops, of the list in a page), ``tries``. A page that can't be fetched fails its task, which Spark tries again.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page long, record string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.path = options["url"], [p for p in options.get("path", "rows").split(".") if p]
        self.rows, self.length, self.tries = int(options.get("rows", 100)), int(options.get("length", 100)), int(options.get("tries", 3))

    def partitions(self) -> list[InputPartition]:
        return [Page(at) for at in range(0, self.rows, self.length)]

    def read(self, partition: Page) -> Iterator[tuple]:
        url = self.url.replace("{offset}", str(partition.offset)).replace("{length}", str(self.length))
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(url, timeout=30) as answer:  # certificates are verified
                    found = json.load(answer)
                break
            except OSError:
                if attempt + 1 == self.tries:
                    raise
                time.sleep(2**attempt)
        for step in self.path:
            found = found.get(step, []) if isinstance(found, dict) else found
        for record in found if isinstance(found, list) else found.values():
            yield partition.offset // self.length, json.dumps(record, ensure_ascii=False)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)
