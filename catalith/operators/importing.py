"""Whole imports and backfills: every table of the catalog as it is afterwards, and its publication as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import version as V
from catalith.functions.names import name_key
from catalith.functions.paths import canonical_name, top_level
from catalith.operators.history import KEY
from catalith.operators.merge import backfilled_ranges, overlapping_ranges, previous_imports, staged_ranges
from catalith.operators.status import numbered, row_counts
from catalith.session import materialised
from catalith.sources.catalog import Catalog

VARIANT = ["version_id", "system", "attr_path"]
#: What a content brings to its variant; a column that the arriving rows lack stays null.
CONTENT = ["meta_id", "commit_seq", "store_hash", "store_name", "meta_name", "meta_version", "program", "broken", "insecure", "content_hash"]
TERM = ["package_id", "name", "attr_path", "top_level_attr"]


# ---------------------------------------------------------------- what arrives


def evaluation_of(decoded: DataFrame, system: str, commit_hash: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``imported`` takes, ``(evals, contents, metas)``, of one evaluation's decoded packages (rows of ``decode.DECODED``).

    A package goes by the name of its attribute path (``canonical_name``); the evaluation's system counts, whatever a package says. Packages without
    a version are left out. A package with a version but without a store path is a stub that should never have come here: the whole evaluation is refused.
    """
    rows = decoded.where(F.col("version") != "").withColumns({"system": F.lit(system), "commit_hash": F.lit(commit_hash), "name": canonical_name(F.col("attr_path"))})
    rows = materialised(rows.withColumn("name_key", name_key(F.col("name"))))
    if stubs := rows.where(F.coalesce("store_hash", F.lit("")) == "").select("attr_path").limit(5).collect():
        raise ValueError(f"refused, as packages have no store path: {[r.attr_path for r in stubs]}")
    key = ["commit_hash", "system", *KEY, "meta_hash"]
    contents = rows.select(*key, "store_hash", "store_name", "meta_name", F.array("meta_version").alias("meta_version"), "program", "broken", "insecure", "content_hash")
    return rows.select(*key, "name", "content_hash"), contents, rows.select("meta_hash", "summary", "description", "homepage", "license", "platforms")


def placed_commits(c: Catalog, commits: DataFrame, moment) -> DataFrame:
    """The table of commits with those of ``commits (hash, committed_at)`` that it lacks, numbered on from the head by their time.

    A known hash, whatever its letter case, keeps its number. A new commit that isn't newer than the head raises an error, as places must be
    dense and in order. Null hashes are no commits; of several times of one hash the first counts.
    """
    old = c.commits("seq", "hash", "committed_at", "imported_at")
    new = commits.where(F.col("hash").isNotNull()).groupBy(F.lower("hash").alias("hash")).agg(F.min("committed_at").alias("committed_at"))
    new = new.join(old.select(F.lower("hash").alias("hash")), "hash", "left_anti")
    head, at = old.agg(F.coalesce(F.max("seq"), F.lit(0)), F.max_by("committed_at", "seq")).first()
    late = new.where(F.col("committed_at").isNull() | (F.col("committed_at") <= F.lit(at))).limit(5).collect()
    if late:
        raise ValueError(f"commits not newer than the head, {head} of {at}: {[(r.hash, r.committed_at) for r in late]}")
    added = numbered(new, ["committed_at", "hash"], "_n").select((F.col("_n") + head).cast(old.schema["seq"].dataType).alias("seq"), "hash", "committed_at", F.lit(moment).cast("timestamp_ntz").alias("imported_at"))
    return old.unionByName(added)


def new_evaluations(c: Catalog, evals: DataFrame) -> DataFrame:
    """Rows of evaluations that aren't imported yet; one that is older than its system's newest import raises an error."""
    on = ["system", "commit_seq"]
    fresh = evals.join(c.imports(*on), on, "left_anti")
    heads = c.imports(*on).groupBy("system").agg(F.max("commit_seq").alias("_head"))
    late = fresh.select(*on).distinct().join(F.broadcast(heads), "system").where(F.col("commit_seq") < F.col("_head")).limit(5).collect()  # a row a system
    if late:
        raise ValueError(f"evaluations older than what their system has: {[(r.system, r.commit_seq) for r in late]}")
    return fresh


def _added(old: DataFrame, new: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """The old rows and the new ones, whose ids go on from the old; columns that the new ones lack are null."""
    last = old.agg(F.coalesce(F.max(ident), F.lit(0))).first()[0]
    rows = numbered(new, order, ident).withColumn(ident, (F.col(ident) + last).cast(old.schema[ident].dataType))
    return old.unionByName(rows.select(*(F.col(k) if k in rows.columns else F.lit(None).cast(old.schema[k].dataType).alias(k) for k in old.columns)))


def _known(c: Catalog, wanted: DataFrame, metas: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packages (with ``name_key``), versions and metadata with what ``wanted (name_key, version, name)`` and ``metas`` add."""
    packages = c.packages("package_id", "name", "name_key")
    named = wanted.groupBy("name_key").agg(F.min("name").alias("name")).join(packages.select("name_key"), "name_key", "left_anti")
    packages = _added(packages, named, "package_id", ["name", "name_key"])
    versions = c.versions("version_id", "package_id", "version", "sort_key", "prerelease", *(f"semver_{x}" for x in ("major", "minor", "patch", "pre")))
    listed = wanted.select("name_key", "version").distinct().join(packages, "name_key").select("package_id", "version")
    made = listed.join(versions.select("package_id", "version"), ["package_id", "version"], "left_anti").withColumn("_s", V.semver(F.col("version")))
    made = made.select("package_id", "version", V.sort_key(F.col("version")).alias("sort_key"), V.is_prerelease(F.col("version")).alias("prerelease"), *(F.col(f"_s.{x}").alias(f"semver_{x}") for x in ("major", "minor", "patch")), F.nullif(F.col("_s.pre"), F.lit("")).alias("semver_pre"))
    versions = _added(versions, made, "version_id", ["package_id", "version"])
    meta = c.meta("meta_id", "meta_hash", "summary", "description", "homepage", "license", "platforms")
    if metas is not None:
        described = metas.withColumn("meta_hash", F.lower("meta_hash")).where(F.col("meta_hash").isNotNull()).dropDuplicates(["meta_hash"])
        meta = _added(meta, described.join(meta.select(F.lower("meta_hash").alias("meta_hash")), "meta_hash", "left_anti"), "meta_id", ["meta_hash"])
    return packages, versions, meta


def _identified(rows: DataFrame, packages: DataFrame, versions: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows by ``KEY`` and ``meta_hash`` with the ids of their version and metadata."""
    rows = rows.join(packages.select("package_id", "name_key"), "name_key").join(versions.select("version_id", "package_id", "version"), ["package_id", "version"])
    return rows.join(meta.select("meta_id", F.lower("meta_hash").alias("meta_hash")), "meta_hash", "left")


def written_over(old: DataFrame, rows: DataFrame, late: bool = False) -> DataFrame:
    """The variants ``old`` after ``rows (*VARIANT, *CONTENT)``, one a variant, are written over them; new ones get ids.

    A row takes its variant's place if the content differs. With ``late``, the rule of history that is filled in afterwards, only a row that was
    seen later does, and one of the same content moves the date back.
    """
    rows = rows.select(*VARIANT, *(F.col(x) if x in rows.columns else F.lit(None).cast(old.schema[x].dataType).alias(x) for x in CONTENT))
    rows = rows.groupBy(*VARIANT).agg(F.max_by(F.struct(*CONTENT), F.struct("commit_seq", "content_hash")).alias("_new"))
    both = old.join(rows, VARIANT, "left")
    same = F.lower("content_hash").eqNullSafe(F.lower("_new.content_hash"))
    takes = (F.col("_new.commit_seq") > F.col("commit_seq")) | (same & (F.col("_new.commit_seq") < F.col("commit_seq"))) if late else ~same
    takes = F.coalesce(F.col("_new").isNotNull() & takes, F.lit(False))
    over = both.select("variant_id", *VARIANT, *(F.when(takes, F.col(f"_new.{x}")).otherwise(F.col(x)).alias(x) for x in CONTENT))
    fresh = rows.join(old.select(*VARIANT), VARIANT, "left_anti").select(*VARIANT, "_new.*")
    return _added(over, fresh, "variant_id", VARIANT)


def _terms(c: Catalog, rows: DataFrame, packages: DataFrame) -> DataFrame:
    """The stored search terms with those of ``rows (name_key, attr_path)``."""
    own = rows.select("name_key", "attr_path").distinct().join(packages, "name_key").select("package_id", "name", "attr_path", top_level(F.col("attr_path")).alias("top_level_attr"))
    return c.search_terms.select(*TERM).unionByName(own.distinct().join(c.search_terms.select("package_id", "attr_path"), ["package_id", "attr_path"], "left_anti"))


def _stored(packages, versions, meta, variants, ranges, terms, imports, commits) -> dict[str, DataFrame]:
    return {
        "packages": packages.withColumnRenamed("package_id", "id"),  # with their keys, so that lookups are filtered by the scan
        "versions": versions.withColumnRenamed("version_id", "id"),
        "meta": meta.withColumnsRenamed({"meta_id": "id", "meta_hash": "hash"}),
        "variants": variants.withColumnRenamed("variant_id", "id"),
        "variant_ranges": ranges,
        "search_terms": terms,
        "commit_systems": imports,
        "commits": commits,
    }


# ---------------------------------------------------------------- an import


def imported(c: Catalog, evals: DataFrame, contents: DataFrame, moment, metas: DataFrame | None = None, commits: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables after importing ``evals`` (rows of stage_keys), whose contents are in ``contents`` (rows of stage_variants).

    One evaluation a system. Both name their commit by ``commit_seq``, or by ``commit_hash`` with ``commits (hash, committed_at)``, which are placed
    first (``placed_commits``). Names and versions that are new are added with keys and marks of the engine's own, variants that
    are new or differ get the evaluation's content and commit, ranges are closed at the system's import before and opened
    at this one, search terms are added, and the import is recorded at ``moment``. ``metas`` has metadata that may be new (hash and description); a
    variant whose metadata is unknown has none. What is imported already changes nothing. Copies count once.
    """
    table = c.commits() if commits is None else placed_commits(c, commits, moment)
    if commits is not None:
        place = table.select(F.lower("hash").alias("commit_hash"), F.col("seq").alias("commit_seq"))
        evals, contents = (df.withColumn("commit_hash", F.lower("commit_hash")).drop("commit_seq").join(place, "commit_hash") for df in (evals, contents))
    evals = new_evaluations(c, evals.where(F.col("name_key").isNotNull()))
    evals = evals.groupBy("system", "commit_seq", *KEY).agg(F.min("name").alias("name"), F.min(F.lower("meta_hash")).alias("meta_hash"), F.min(F.lower("content_hash")).alias("content_hash"))
    evals = materialised(evals)  # what arrives is read by every table
    packages, versions, meta = _known(c, evals, metas)

    more = [x for x in ("meta_name", "meta_version", "program") if x in contents.columns]
    held = contents.where(F.col("store_hash") != "").groupBy("commit_seq", "system", *KEY).agg(*(F.min(x).alias(x) for x in ("store_hash", "store_name", "broken", "insecure", *more)), F.min(F.lower("meta_hash")).alias("meta_hash"), F.min(F.lower("content_hash")).alias("_held"))
    listed = evals.select("system", "commit_seq", *KEY, "content_hash").join(packages.select("package_id", "name_key"), "name_key").join(versions.select("version_id", "package_id", "version"), ["package_id", "version"])
    arrived = evals.select("system", "commit_seq", *KEY, "content_hash").join(held, ["commit_seq", "system", *KEY]).withColumn("content_hash", F.coalesce("content_hash", "_held"))
    arrived = _identified(arrived, packages, versions, meta)
    variants = written_over(c.variants("variant_id", *VARIANT, *CONTENT), arrived)

    ranges = c.ranges()
    present = listed.join(variants.select("variant_id", *VARIANT), VARIANT).select("variant_id", F.col("commit_seq").alias("_now")).distinct()
    before = previous_imports(c, evals).select("system", "previous_seq")
    of = variants.select("variant_id", "system").join(F.broadcast(before), "system")  # a row a system
    standing = ranges.join(of, "variant_id", "left").join(present, "variant_id", "left")
    gone = F.col("last_seq").isNull() & F.col("_now").isNull() & F.col("previous_seq").isNotNull()
    kept = standing.withColumn("last_seq", F.when(gone, F.col("previous_seq")).otherwise(F.col("last_seq"))).select(*ranges.columns)
    opened = present.join(ranges.where(F.col("last_seq").isNull()).select("variant_id"), "variant_id", "left_anti").withColumnRenamed("_now", "first_seq")
    opened = opened.join(ranges.select("variant_id", "first_seq"), ["variant_id", "first_seq"], "left_anti")
    opened = opened.withColumns({"last_seq": F.lit(None).cast("int"), "seeded": F.lit(False), "backfill_last_seq": F.lit(None).cast("int")})
    record = evals.select("commit_seq", "system").distinct().withColumns({"imported_at": F.lit(moment).cast("timestamp_ntz"), "nix_version": F.lit(None).cast("string")})
    return _stored(packages, versions, meta, variants, kept.unionByName(opened.select(*ranges.columns)), _terms(c, evals, packages), c.imports().unionByName(record), table)


# ---------------------------------------------------------------- history filled in afterwards


def backfilled(c: Catalog, ranges: DataFrame, dated: DataFrame, metas: DataFrame | None = None, windows: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables after history is filled in: ``ranges`` are rows of stage_backfill_ranges, ``dated`` the content of their keys at ``commit_seq``.

    Names, versions and metadata that are new are added, contents written under the rule of late history, parts that an earlier backfill left in
    the ``windows (system, first_seq, last_seq)`` (those that the ranges span, if not given) are taken back, and the ranges applied.
    Ranges that then still meet others raise an error, and nothing is written. Doing it again changes nothing.
    """
    dated = dated.where(F.col("name_key").isNotNull()).withColumn("meta_hash", F.lower("meta_hash"))
    dated = materialised(dated if "name" in dated.columns else dated.withColumn("name", F.col("name_key")))
    packages, versions, meta = _known(c, dated, metas)
    variants = materialised(written_over(c.variants("variant_id", *VARIANT, *CONTENT), _identified(dated, packages, versions, meta).withColumn("content_hash", F.lower("content_hash")), late=True))
    after = Catalog(c.spark, c.base)
    after._raw = c._raw | {"packages": packages.withColumnRenamed("package_id", "id"), "versions": versions.withColumnRenamed("version_id", "id"), "variants": variants.withColumnRenamed("variant_id", "id"), "stage_backfill_ranges": ranges}
    staged = staged_ranges(after)
    if met := overlapping_ranges(after, staged, windows, taken_back=True).limit(5).collect():
        raise ValueError(f"refused, as live ranges are met: {[tuple(r) for r in met]}")
    return _stored(packages, versions, meta, variants, backfilled_ranges(after, staged, windows), _terms(c, dated, packages), c.imports(), c.commits())


# ---------------------------------------------------------------- publication


def changes(c: Catalog, tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, before, after, added, removed)`` in rows: what publishing ``tables`` would do. Computing it writes nothing."""
    out = None
    for name, df in tables.items():
        old = c.search_terms if name == "search_terms" else c.raw(name)
        cols = [k for k in old.columns if k in df.columns]
        count = lambda rows, label: rows.agg(F.count(F.lit(1)).alias(label))
        old, new = old.select(*cols).distinct(), df.select(*cols).distinct()
        parts = [count(old, "before"), count(new, "after"), count(new.exceptAll(old), "added"), count(old.exceptAll(new), "removed")]
        row = parts[0]
        for p in parts[1:]:
            row = row.join(F.broadcast(p))  # one row
        row = row.select(F.lit(name).alias("table_name"), "before", "after", "added", "removed")
        out = row if out is None else out.unionByName(row)
    return out


def _pointers(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/published")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def newest(spark: SparkSession, root: str) -> int:
    """The number of the catalog that was published last, 0 if none was."""
    path, fs = _pointers(spark, root)
    return max((int(s.getPath().getName()) for s in (fs.listStatus(path) if fs.exists(path) else []) if s.getLen() and s.getPath().getName().isdigit()), default=0)


def publish(tables: dict[str, DataFrame], root: str, number: int | None = None) -> str:
    """Writes all tables, and their row counts, into a new folder and only then names it as the catalog of that number (the next one if None).

    The name is a file that is created only if it isn't there: of two runs with one number the second fails, and what was published before
    stands until the file is whole. A number that isn't above the newest is refused before anything is written.
    """
    spark = next(iter(tables.values())).sparkSession
    last = newest(spark, root)
    number = last + 1 if number is None else number
    if number <= last:
        raise ValueError(f"catalog {number} would not follow the newest, {last}")
    folder = f"{root}/snap={number}-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    row_counts(Catalog(spark, folder)).write.parquet(f"{folder}/row_counts.parquet")
    path, fs = _pointers(spark, root)
    try:
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, str(number)), False)
    except Exception as e:
        raise ValueError(f"another run has published catalog {number}") from e
    out.write(bytearray(folder.encode()))
    out.close()
    return folder


def current(spark: SparkSession, root: str) -> Catalog:
    """The catalog that was published last."""
    if not (number := newest(spark, root)):
        raise ValueError(f"nothing is published in {root}")
    return Catalog(spark, spark.read.text(f"{root}/published/{number}").first()[0])
