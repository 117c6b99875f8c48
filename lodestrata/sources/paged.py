"""A data source over a paged XML service: a partition for each page.

The service is asked once for its number of rows, then each task fetches its own pages.
``fetch`` is the dotted name of a function (start, end) -> XML text, so that tests and
offline runs need no network; with the option ``service`` it is called with that text as a third argument.
"""

from __future__ import annotations

import importlib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PAGE = 1000
#: Result code of a page with rows.
FINE = "INFO-000"


@dataclass
class Page(InputPartition):
    start: int
    end: int


def resolve(name: str) -> Callable[[int, int], str]:
    module, _, attribute = name.rpartition(".")
    return getattr(importlib.import_module(module), attribute)


def rows_of(text: str) -> list[dict[str, str]]:
    """Children of each row; none if the page's code says anything but FINE."""
    root = ET.fromstring(text)
    code = root.findtext(".//CODE")
    if code is not None and code != FINE:
        return []
    return [{child.tag: (child.text or "") for child in row} for row in root.iter("row")]


def total_of(text: str) -> int:
    return int(ET.fromstring(text).findtext(".//list_total_count") or 0)


class PagedXml(DataSource):
    """``spark.read.format("paged_xml").schema(...).option("fetch", "module.function")``."""

    @classmethod
    def name(cls) -> str:
        return "paged_xml"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options["fetch"], int(self.options.get("page", PAGE)), self.options.get("service"))


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, fetch: str, page: int, service: str | None = None):
        self.names, self.fetch, self.page, self.service = schema.fieldNames(), fetch, page, service

    def asked(self, start: int, end: int) -> str:
        return resolve(self.fetch)(start, end, *([] if self.service is None else [self.service]))

    def partitions(self) -> list[Page]:
        total = total_of(self.asked(1, 1))
        return [Page(i, min(i + self.page - 1, total)) for i in range(1, total + 1, self.page)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for row in rows_of(self.asked(partition.start, partition.end)):
            yield tuple(row.get(n) for n in self.names)
