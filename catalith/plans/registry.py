"""All queries of the core by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalith.plans import catalog_queries, problems

QUERIES = {**problems.QUERIES, **catalog_queries.QUERIES}
SQL = {**problems.SQL, **catalog_queries.SQL}


def flagship(spark: SparkSession, base: str) -> DataFrame:
    return QUERIES["latest_per_package"](spark, base)
