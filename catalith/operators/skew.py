"""Finding the keys whose rows one task should not take."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.session import BROADCAST_ROWS, materialised

#: Rows of one key from which it is hot: what a task takes with ease, the same whatever the size of the table.
HOT_ROWS = 10_000


@dataclass(frozen=True)
class HotKeys:
    """``table (field, key, n)`` of the hot keys and how many there are, counted."""

    table: DataFrame
    count: int

    def of(self, field: str) -> DataFrame:
        """``(key)`` of one field, broadcast as their number is known to be small (see ``few``)."""
        return F.broadcast(self.table.where(F.col("field") == field).select("key"))

    @property
    def few(self) -> bool:
        """Whether the hot keys can be broadcast; where they can't, all rows are to be treated as rows of hot keys."""
        return self.count <= BROADCAST_ROWS


def hot_keys(df: DataFrame, keys: list[str], *, rows: int = HOT_ROWS) -> HotKeys:
    """The values of each of the ``keys`` columns (all of one type) that hold at least ``rows`` rows, by exact counts.

    One pass over these columns alone, counts being combined before the shuffle; the result is written once, as later plans
    use it more than once. A null key is never hot; an empty table has none.
    """
    pairs = [F.struct(F.lit(k).alias("field"), F.col(k).alias("key")) for k in keys]
    listed = df.select(F.explode(F.array(*pairs)).alias("_p")).select("_p.*") if len(keys) > 1 else df.select(pairs[0].alias("_p")).select("_p.*")
    found = materialised(listed.where(F.col("key").isNotNull()).groupBy("field", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rows))
    return HotKeys(found, found.count())
