"""References to records that don't exist, or that came later than the record that refers to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.operators.skew import HOT_ROWS, HotKeys, hot_keys

#: Shares of the rows where the hot keys are too many to be broadcast.
SALTS = 256


@dataclass(frozen=True)
class Reference:
    """A foreign key: ``key`` is taken from the child rows, ``parents (key[, arrived])`` has the keys that exist.

    Null and empty keys are no references. With an ``arrived`` column in ``parents``, a record that arrived
    (at its earliest) after the child row's ``moment`` counts as late.
    """

    target: str
    key: Column
    parents: DataFrame


def orphan_references(rows: DataFrame, row_id: str, references: list[Reference], *, period: Column, moment: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(row_id, target, period, reason)`` of each reference that is ``missing`` or ``late``.

    The distinct keys are anti-joined against the parents and only what is orphaned goes back to the rows.
    Keys with at least ``hot_rows`` rows, at any size of the table, are found by exact counts, all references in one pass.
    Their rows never meet in one task: what is orphaned of the hot keys is broadcast. If the hot keys are too many for that, every orphaned key is
    repeated for each of ``SALTS`` shares of the rows. Copies of a row give one result row. A null period or
    row id stays null; a null moment is never late. Empty tables give no rows, and without parents every reference is missing.
    """
    keys = [f"_key{k}" for k in range(len(references))]
    child = rows.select(F.col(row_id).alias("row_id"), period.alias("period"), moment.alias("_moment"), *(F.nullif(r.key, F.lit("")).alias(k) for r, k in zip(references, keys)))
    hot = hot_keys(child, keys, rows=hot_rows)
    out = None
    for ref, key in zip(references, keys):
        own = child.select("row_id", "period", "_moment", F.col(key).alias("_key")).where(F.col("_key").isNotNull())
        found = _orphans(own, ref, hot, key).select(F.col("row_id").alias(row_id), F.lit(ref.target).alias("target"), "period", "reason")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _orphans(child: DataFrame, ref: Reference, hot: HotKeys, field: str) -> DataFrame:
    late = "arrived" in ref.parents.columns
    parents = ref.parents.select(F.col("key").alias("_key"), *(["arrived"] if late else [])).where(F.col("_key").isNotNull())
    parents = parents.groupBy("_key").agg(F.min("arrived").alias("_arrived")) if late else parents.distinct()

    def judged(keys: DataFrame) -> DataFrame:
        missing = keys.join(parents, "_key", "left_anti").select("_key", F.lit(None).cast("timestamp_ntz").alias("_arrived"), F.lit("missing").alias("reason"))
        if not late:
            return missing
        return missing.unionByName(keys.join(parents, "_key").select("_key", F.col("_arrived").cast("timestamp_ntz").alias("_arrived"), F.lit("late").alias("reason")))

    if not hot.count:
        both = child.join(judged(child.select("_key").distinct()), "_key")
    elif hot.few:
        known = hot.of(field).withColumnRenamed("key", "_key")
        light = child.join(known, "_key", "left_anti")
        both = light.join(judged(light.select("_key").distinct()), "_key").unionByName(child.join(F.broadcast(judged(known)), "_key"))
    else:
        salted = child.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)))
        repeated = judged(child.select("_key").distinct()).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        both = salted.join(repeated, ["_key", "_salt"]).drop("_salt")
    return both.where((F.col("reason") == "missing") | (F.col("_arrived") > F.col("_moment")))


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """``(target, period, reason, n_rows)`` of what ``orphan_references`` gives."""
    return orphans.groupBy("target", "period", "reason").agg(F.count(F.lit(1)).alias("n_rows"))
