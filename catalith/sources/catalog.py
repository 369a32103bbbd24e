"""The catalog as a set of tables, copies of a record made one."""

from __future__ import annotations

from functools import cached_property

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.names import name_key
from catalith.functions.paths import top_level
from catalith.session import BROADCAST_ROWS
from catalith.sources.tables import table


class Catalog:
    """Tables of one data folder. Each method is a plan that reads only the columns asked for."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """The table as it is; its schema is read once."""
        if name not in self._raw:
            self._raw[name] = table(self.spark, self.base, name)
        return self._raw[name]

    def has(self, name: str) -> bool:
        """Whether the folder has a table."""
        try:
            return bool(self.raw(name).columns)
        except AnalysisException:
            return False

    def _records(self, name: str, ident: str, new: str, cols: tuple[str, ...], among: DataFrame | None = None) -> DataFrame:
        """The columns asked for (all for none), copies of a record made one over these columns and the id alone.

        ``among`` has one column; only records that share its values are read on, which is settled before copies are made one.
        """
        rows = self.raw(name).withColumnRenamed(ident, new)
        if among is not None:
            rows = rows.join(among, among.columns[0], "left_semi")
        return rows.select(new, *(k for k in cols if k != new)).distinct().select(*cols) if cols else rows.distinct()

    def packages(self, *cols: str, among: DataFrame | None = None) -> DataFrame:
        """``(package_id, name, name_key)``; the key is computed where the table doesn't store it."""
        stored = "name_key" in self.raw("packages").columns
        rows = self._records("packages", "id", "package_id", ("package_id", "name", *["name_key"] * stored), among)
        rows = rows if stored else rows.withColumn("name_key", name_key(F.col("name")))
        return rows.select(*cols) if cols else rows

    def packages_named(self, keys: DataFrame) -> DataFrame:
        """``(package_id, *keys)`` of the packages whose key is in ``keys (name_key, ...)``.

        A stored key is filtered by the scan. Else names within ASCII are compared in lower case by the JVM; only the others see Python.
        """
        rows = self.raw("packages").select(F.col("id").alias("package_id"), *(["name_key"] if "name_key" in self.raw("packages").columns else ["name"]))
        if "name_key" not in rows.columns:
            plain = F.col("name").rlike(r"^[\x00-\x7f]*$")
            rows = rows.where(plain).select("package_id", F.lower("name").alias("name_key")).unionByName(rows.where(~plain).select("package_id", name_key(F.col("name")).alias("name_key")))
        return rows.join(keys, "name_key").distinct()

    def versions(self, *cols: str, among: DataFrame | None = None) -> DataFrame:
        return self._records("versions", "id", "version_id", cols, among)

    def variants(self, *cols: str, among: DataFrame | None = None) -> DataFrame:
        return self._records("variants", "id", "variant_id", cols, among)

    def shown_variants(self, among: DataFrame | None = None) -> DataFrame:
        """What a result row shows of variants."""
        columns = "variant_id version_id system attr_path meta_id commit_seq store_hash store_name meta_name meta_version program broken insecure"
        return self.variants(*columns.split(), among=among)

    def ranges(self, *cols: str, among: DataFrame | None = None) -> DataFrame:
        """Of some columns only the different ones."""
        rows = self.raw("variant_ranges")
        rows = rows if among is None else rows.join(among, among.columns[0], "left_semi")
        return (rows.select(*cols) if cols else rows).distinct()

    def meta(self, *cols: str) -> DataFrame:
        rows = self._records("meta", "id", "meta_id", tuple("hash" if k == "meta_hash" else k for k in cols))
        return rows.withColumnRenamed("hash", "meta_hash")

    def commits(self, *cols: str) -> DataFrame:
        return self._records("commits", "seq", "seq", cols)

    def imports(self, *cols: str) -> DataFrame:
        """Of some columns only the different ones."""
        rows = self.raw("commit_systems")
        return (rows.select(*cols) if cols else rows).distinct()

    @cached_property
    def search_terms(self) -> DataFrame:
        """``(package_id, name, attr_path, top_level_attr)``: each name with the attribute paths that serve it; stored by imports, else derived."""
        if self.has("search_terms"):
            return self.raw("search_terms").select("package_id", "name", "attr_path", "top_level_attr").distinct()
        v = self.raw("variants").select("version_id", "attr_path").distinct()
        owned = v.join(self.versions("version_id", "package_id"), "version_id").select("package_id", "attr_path").distinct()
        terms = owned.join(self.packages("package_id", "name"), "package_id")
        return terms.select("package_id", "name", "attr_path", top_level(F.col("attr_path")).alias("top_level_attr"))


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows from the driver as one relation of the plan, whose size the optimizer knows; no Python worker makes them."""
    names = [f.split()[0] for f in schema.split(",")]
    kinds = [{"int": pa.int32(), "string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[f.split()[1]] for f in schema.split(",")]
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=names))


def given(df: DataFrame, rows: int) -> DataFrame:
    """A table made of so many rows from the driver, to be broadcast if that is few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, to be broadcast if it is counted to be small; left to the optimizer otherwise."""
    return F.broadcast(df) if df.count() <= rows else df
