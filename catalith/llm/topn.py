"""The N best items of every group, however large a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.operators.skew import HOT_ROWS, hot_keys


def top_n(rows: DataFrame, group: str, items: list[str], order: list[Column], n: int, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(group, place, *items)``: the first ``n`` of every group by ``order``, place counting from 1.

    ``order`` are sort expressions over ``items`` (or other columns, which are then not in the result) and must leave no
    tie between different items; copies of an item take one place. Rows with a null group are in no group;
    filter rows that may have no place beforehand. Binary columns compare as unsigned bytes, strings by their
    UTF-8 bytes. Empty tables give no rows; groups with fewer items have fewer places.

    Exact counts split the groups; a group is heavy from ``hot_rows`` rows on, at any size of the table. Light groups are ranked by one
    window: every input partition keeps its own first ``n`` places of a group before anything is shuffled, copies sharing a place.
    The rows of heavy groups are made distinct and sorted by range over all tasks, so that a group lies in as many pieces as it
    needs; each piece is cut down to ``n`` rows where it lies, then the pieces meet. If the heavy groups are too many to be
    broadcast, all groups go that way.
    """
    rows = rows.where(F.col(group).isNotNull())
    hot = hot_keys(rows, [group], rows=hot_rows)
    if not hot.count:
        out = _windowed(rows, group, order, n)
    elif hot.few:
        keys = hot.of(group).withColumnRenamed("key", group)
        out = _windowed(rows.join(keys, group, "left_anti"), group, order, n).unionByName(_ranged(rows.join(keys, group, "left_semi"), group, order, n))
    else:
        out = _ranged(rows, group, order, n)
    return out.select(group, "place", *items)


def _first(df: DataFrame, by: list[str], order: list[Column], n: int, rank=F.row_number) -> DataFrame:
    return df.withColumn("place", rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def _windowed(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """One window over the group; as copies share a dense rank, the planner cuts each input partition down to ``n`` places first."""
    return _first(_first(rows, [group], order, n, F.dense_rank).drop("place").distinct(), [group], order, n)


def _ranged(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The pieces of the range sort are the salt."""
    pieces = rows.distinct().repartitionByRange(F.col(group), *order).withColumn("_salt", F.spark_partition_id())
    return _first(_first(pieces, [group, "_salt"], order, n).drop("place", "_salt"), [group], order, n)
