"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean
from ..sources import tables
from .oracle import AS_OF, AS_OF_YEAR

__all__ = ["AS_OF", "AS_OF_YEAR", "market", "listings", "usage", "training"]


def listings(spark: SparkSession, sf: str) -> DataFrame:
    return tables.listings(spark, sf)


def market(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned, decoded listings as the dashboard reads them."""
    return clean.market_listings(tables.listings(spark, sf), AS_OF_YEAR)


def training(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned, strictly encoded listings as the training job reads them."""
    return clean.training_listings(tables.listings(spark, sf), AS_OF_YEAR)


def usage(spark: SparkSession, sf: str) -> DataFrame:
    return tables.usage_log(spark, sf)
