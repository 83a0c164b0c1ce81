"""The store: its tables as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.catalogue import active_promotions, build_catalogue, listing
from vitrine.operators.search import SearchIndex
from vitrine.sources.files import current_folders
from vitrine.sources.schemas import TABLES


@dataclass(frozen=True)
class Store:
    categories: DataFrame
    products: DataFrame
    customers: DataFrame
    orders: DataFrame
    order_items: DataFrame
    promotions: DataFrame
    index: SearchIndex | None = None

    @classmethod
    def open(cls, spark: SparkSession, base: str) -> Store:
        """Tables written by ``files.load_all``."""
        folders = current_folders(spark, base)
        return cls(**{name: spark.read.parquet(folders[name]) for name in TABLES})

    def indexed(self, path: str | None = None) -> Store:
        """This store with its search index, which searches then share; ``path`` keeps it for later sessions."""
        return replace(self, index=SearchIndex.build(self.listing, path))

    @property
    def searchable(self) -> SearchIndex | DataFrame:
        return self.index or self.listing

    @property
    def listing(self) -> DataFrame:
        return listing(self.products, self.categories)

    @property
    def catalogue(self) -> DataFrame:
        return build_catalogue(self.products, self.categories, self.promotions)

    @property
    def active_promotions(self) -> DataFrame:
        return active_promotions(self.promotions, self.products)


def parsed_specs(raw: Column) -> Column:
    """Specs that are one JSON value, types and nesting kept; any other text gives NULL and stays readable in the raw
    column. The parser stops at the end of a value, so the text must also be one element of an array."""
    single = F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1
    return F.when(single, F.try_parse_json(raw))
