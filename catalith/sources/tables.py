"""Readers of the catalog's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from catalith.session import ship

#: Schemas that were read before, by application, path and state of the path.
_schemas: dict[tuple, StructType] = {}


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; columns are pruned and filters pushed by the reader.

    The schema of a path is read once, as that is a job of its own, and again when the path's length or time has changed.
    """
    ship(spark)
    path, sc = f"{base}/{name}.parquet", spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return spark.read.parquet(path)  # the reader's own error, or a pattern
    state = fs.getFileStatus(at)
    key = (sc.applicationId, path, state.getLen(), state.getModificationTime())
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def database_table(spark: SparkSession, url: str, name: str, *, key: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database over JDBC, whose driver must be on the class path; filters and columns are pushed to it.

    With an integer ``key`` column and its bounds the rows are read in ``parts`` ranges at once; rows beyond the bounds come with the first and the last.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, fetchsize="10000", **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()
