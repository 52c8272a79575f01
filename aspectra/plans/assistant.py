"""The five question tools as lazy plans, and a scripted planner in place of a language model."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from aspectra.operators import search
from aspectra.plans.constants import ASPECTS, TOP_K
from aspectra.plans.providers import Encoder, query_vector


def first_that_works(wanted: Callable[[], DataFrame], fallback: Callable[[], DataFrame]) -> DataFrame:
    """The rows of a short list, which is run here; where the engine fails to make or run it, the fallback's plan. The error is logged."""
    try:
        found = wanted()
        return found.sparkSession.createDataFrame(found.collect(), found.schema)
    except (PySparkException, Py4JError):
        logging.getLogger(__name__).exception("falling back")
        return fallback()


@dataclass
class Assistant:
    products: DataFrame
    dims: dict[str, DataFrame]
    embeddings: DataFrame
    encoder: Encoder
    hypothetical: Callable | None = None
    trigram: bool = True

    def search_product(self, query: str) -> DataFrame:
        """Similar names; names that contain the query where similarity is switched off or fails."""
        plain = lambda: search.search_ilike(self.products, query)
        return first_that_works(lambda: search.search_trigram(self.products, query), plain) if self.trigram else plain()

    def list_products(self, max_price: int | None = None, brand: str | None = None) -> DataFrame:
        return search.list_products(self.products, max_price, brand)

    def get_specs(self, product: int, aspect: str) -> DataFrame:
        search.check_aspect(aspect)
        return search.specs_of(self.dims[aspect], product, aspect)

    def get_all_specs(self, product: int) -> DataFrame:
        own = {a: self.dims[a].where(self.dims[a].product_id == product) for a in ASPECTS}
        return search.all_specs(own, {a: c for a, (_, c) in ASPECTS.items()}).orderBy("place")

    def get_comments(self, product: int, aspect: str, query: str, top: int = TOP_K) -> DataFrame:
        """Nearest comments; any of the aspect's where none has a vector, or where the vector search fails. An encoder's error is raised."""
        table = search.check_aspect(aspect)
        vector = query_vector(query, self.encoder, self.hypothetical)

        def nearest() -> DataFrame:
            return search.nearest_comments(self.embeddings, self.dims[aspect], product, aspect, vector, top)

        def any_of_them() -> DataFrame:
            own = self.dims[aspect].where(self.dims[aspect].product_id == product).select("dim_id")
            return search.random_rows(self.embeddings.where(self.embeddings.dim_table == table).join(own, "dim_id"), top)

        found = first_that_works(nearest, any_of_them)
        return found if found.limit(1).count() else any_of_them()

    def ask(self, question: str, script: list[tuple[str, tuple]]) -> list[DataFrame]:
        """Run scripted tool calls for a question; a blank question is refused."""
        if not question.strip():
            raise ValueError("blank question")
        return [getattr(self, tool)(*arguments) for tool, arguments in script]
