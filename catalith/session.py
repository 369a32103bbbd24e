"""Session helpers: what an operator may assume about the cluster it runs on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a side may be broadcast once its row count is known (about 64 bytes a row).
BROADCAST_ROWS = 500_000

_shipped: set[str] = set()


def materialised(df: DataFrame) -> DataFrame:
    """The rows as they are now, written once into the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Partitions and the order within them stay as they were computed, whatever executors are lost later. Where the setting is
    missing, a folder of this machine is taken on local masters only.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if not shared:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir is unset on a cluster")
            shared = tempfile.mkdtemp(prefix="catalith-checkpoint-")
        sc.setCheckpointDir(shared)
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a real cluster; local masters import it from the path."""
    sc = spark.sparkContext
    if sc.master.startswith("local") or sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="catalith-"), "catalith.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
