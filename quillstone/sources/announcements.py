"""A paginated announcement catalog as a Spark data source.

Each code is a partition, read page by page until a page is empty or says that no more follow. The
pages come from a fetcher named by an import path (``module:function``), called with the code, the
page and the page size; it returns {"announcements": [...], "hasMore": bool}.
"""

from __future__ import annotations

from importlib import import_module
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillstone.functions import constants as C


class CodePartition(InputPartition):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


class AnnouncementReader(DataSourceReader):
    def __init__(self, options: dict):
        self.codes = [c for c in options.get("codes", "").split(",") if c]
        self.fetcher = options["fetcher"]
        self.page_size = int(options.get("pageSize", C.PAGE_SIZE))

    def partitions(self) -> list[InputPartition]:
        return [CodePartition(c) for c in self.codes]

    def read(self, partition: CodePartition) -> Iterator[tuple]:
        module, _, name = self.fetcher.partition(":")
        fetch = getattr(import_module(module), name)
        page = 1
        while True:
            answer = fetch(partition.code, page, self.page_size)
            found = answer.get("announcements") or []
            for a in found:
                yield partition.code, a.get("announcementTitle") or "", a["announcementTime"], a["adjunctUrl"], a.get("adjunctSize") or 0
            if not found or not answer.get("hasMore"):
                return
            page += 1


class AnnouncementSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "announcements"

    def schema(self) -> str:
        return "code string, title string, time_ms bigint, url string, size_kb bigint"

    def reader(self, schema) -> AnnouncementReader:  # noqa: ANN001 - Spark's own type
        return AnnouncementReader(self.options)
