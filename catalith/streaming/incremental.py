"""Evaluations arriving as a stream, merged batch by batch; a batch that comes again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalith.operators.snapshots import imported_only

#: Columns of an evaluation's rows as they arrive.
ARRIVALS = "commit_seq int, system string, name string, name_key string, version string, attr_path string, meta_hash string, content_hash string"


def known_evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """``(system, commit_seq)`` of what the folder's log of imports has."""
    return _log(spark, f"{folder}/imports")


def _log(spark: SparkSession, path: str) -> DataFrame:
    schema = "system string, commit_seq int"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing was written there yet
        return spark.createDataFrame([], schema)


def merge_batch(folder: str, late: str = "raise") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds a batch's new evaluations to the folder, one directory a batch.

    Evaluations (system, commit_seq) that are known already are dropped, copies of a row made one. One that is older than its system's newest is late:
    ``late="raise"`` refuses the batch before anything is written, ``"drop"`` leaves it out. The rows are written before the log that
    names them, and both into directories of the batch's number that a second run overwrites, so a lost batch is simply run again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        others = known_evaluations(spark, folder)
        others = others.join(_log(spark, f"{folder}/imports/batch={number}"), ["system", "commit_seq"], "left_anti")
        on = ["system", "commit_seq"]
        heads = others.groupBy("system").agg(F.max("commit_seq").alias("_head"))
        fresh = batch.select("system", "commit_seq").where("system is not null and commit_seq is not null").distinct().join(others, on, "left_anti")
        judged = fresh.join(heads, "system", "left").withColumn("_late", F.coalesce(F.col("commit_seq") < F.col("_head"), F.lit(False)))
        if late == "raise" and (found := judged.where("_late").limit(5).collect()):
            raise ValueError(f"evaluations older than what their system has: {[(r.system, r.commit_seq) for r in found]}")
        taken = judged.where(~F.col("_late")).select(*on)
        rows = imported_only(batch, taken, on).dropDuplicates()
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        rows = spark.read.parquet(f"{folder}/rows/batch={number}")
        rows.select(*on).distinct().write.mode("overwrite").parquet(f"{folder}/imports/batch={number}")

    return merge


def stream_evaluations(spark: SparkSession, source: str, folder: str, checkpoint: str, late: str = "raise", files: int = 1) -> StreamingQuery:
    """Merges the Parquet files that appear in ``source`` into ``folder`` until none is left; ``checkpoint`` must be in a shared folder."""
    arrivals = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", files).parquet(source)
    return arrivals.writeStream.foreachBatch(merge_batch(folder, late)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
