"""Paged catalogues read by an injected fetcher, slugs side by side on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from aspectra.plans.constants import CRAWL_PAGES, CRAWL_RETRIES
from aspectra.plans.pipeline import with_retries

#: (slug, page) to rows with at least a url.
Fetch = Callable[[str, int], Sequence[dict]]


def pages_of(slug: str, fetch: Fetch, max_pages: int = CRAWL_PAGES, retries: int = CRAWL_RETRIES, wait: float = 1.0) -> Iterator[dict]:
    """Rows of new URLs page by page, with slug and page.

    A failed page is tried again after wait + attempt seconds; the crawl ends at an empty page, one without a new URL,
    or the last page allowed. Rows without a URL are skipped.
    """
    seen: set[str] = set()
    for page in range(1, max_pages + 1):
        rows = with_retries(lambda page=page: fetch(slug, page), retries, lambda attempt: wait + attempt if wait else 0)
        fresh = {r["url"]: r for r in reversed(rows) if r.get("url") and r["url"] not in seen}
        if not fresh:
            return
        seen.update(fresh)
        yield from ({**r, "slug": slug, "page": page} for r in rows if fresh.get(r.get("url")) is r)


def crawl(slugs: DataFrame, slug: str, fetch: Fetch, schema: T.StructType, **options) -> DataFrame:
    """Rows of every slug's crawl; schema names their columns, slug and page among them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one in batch[slug]:
                rows = list(pages_of(one, fetch, **options))
                yield pd.DataFrame([{c: r.get(c) for c in schema.names} for r in rows], columns=schema.names)

    return slugs.select(slug).where(f"`{slug}` is not null").distinct().mapInPandas(run, schema)
