"""A paged catalogue as a data source: spark.read and spark.readStream over an injected fetcher, a partition per slug.

    spark.dataSource.register(catalogue_source(fetch))
    spark.read.format("catalogue").option("slugs", "phones,tablets").load()
    spark.readStream.format("catalogue").option("slugs", "phones").option("pagesPerBatch", 2).load()

Stop rules live in the reader: a slug ends at an empty page, at one without a new
URL, or at maxPages. A stream's offset is the number of pages that it has gone
through; a batch of later pages walks a slug's earlier ones again, so that what
is new is known after a restart and a batch that runs twice gives the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from aspectra.plans.constants import CRAWL_PAGES, CRAWL_RETRIES
from aspectra.sources.crawl import Fetch, pages_of

SCHEMA = "url string, slug string, page int"


class SlugPages(InputPartition):
    """Pages after `done` up to `upto` of one slug."""

    def __init__(self, slug: str, done: int, upto: int):
        super().__init__((slug, done, upto))
        self.slug, self.done, self.upto = slug, done, upto


class _Pages:
    """What the readers of tables and of streams share."""

    def __init__(self, fetch: Fetch, columns: Sequence[str], options: dict[str, str]):
        self.fetch, self.columns = fetch, list(columns)
        self.slugs = list(dict.fromkeys(s.strip() for s in options.get("slugs", "").split(",") if s.strip()))
        if not self.slugs:
            raise ValueError("option slugs names no slug")
        self.max_pages = int(options.get("maxPages", CRAWL_PAGES))
        self.retries, self.wait = int(options.get("retries", CRAWL_RETRIES)), float(options.get("wait", 1.0))
        self.step = int(options.get("pagesPerBatch", self.max_pages))
        if self.step < 1:
            raise ValueError("option pagesPerBatch must be 1 or more")

    def between(self, done: int, upto: int) -> list[SlugPages]:
        return [SlugPages(s, done, upto) for s in self.slugs]

    def read(self, partition: SlugPages) -> Iterator[tuple]:
        for row in pages_of(partition.slug, self.fetch, partition.upto, self.retries, self.wait):
            if row["page"] > partition.done:
                yield tuple(row.get(c) for c in self.columns)


class TableReader(_Pages, DataSourceReader):
    def partitions(self) -> list[SlugPages]:
        return self.between(0, self.max_pages)


class StreamReader(_Pages, DataSourceStreamReader):
    """The offset moves on by pagesPerBatch with each batch, up to maxPages; slugs that ended give no more rows."""

    _at = 0

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        self._at = min(self._at + self.step, self.max_pages)
        return {"pages": self._at}

    def partitions(self, start: dict, end: dict) -> list[SlugPages]:
        self._at = max(self._at, int(end["pages"]))  # after a restart the stream goes on from here
        return self.between(int(start["pages"]), int(end["pages"]))

    def commit(self, end: dict) -> None:
        self._at = max(self._at, int(end["pages"]))


def catalogue_source(fetch: Fetch, name: str = "catalogue") -> type[DataSource]:
    """A data source to register, whose tasks call fetch(slug, page); options slugs, maxPages, retries, wait, pagesPerBatch."""

    class Catalogue(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> DataSourceReader:
            return TableReader(fetch, schema.names, self.options)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return StreamReader(fetch, schema.names, self.options)

    return Catalogue


def recorded_site(root: str) -> Fetch:
    """A fetcher over pages recorded as root/slug/page.json, each a list of rows; a page that is not there is empty."""

    def fetch(slug: str, page: int) -> list[dict]:
        path = Path(root) / slug / f"{page}.json"
        return json.loads(path.read_text()) if path.exists() else []

    return fetch
