"""Merging evaluations into the catalog: what is new, changed, gone or back, and history filled in afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.operators.history import KEY, next_point
from catalith.operators.intervals import OPEN_END
from catalith.operators.lookup import first_per_key
from catalith.session import materialised
from catalith.sources.catalog import Catalog, small

#: Share of changed variants from which an import is worth a warning.
CHANGE_RATIO = 0.2


def newest_evaluations(c: Catalog) -> DataFrame:
    """The rows of stage_keys of each system's newest imported evaluation, copies and letter case of hashes made one."""
    rows = c.raw("stage_keys").withColumns({h: F.lower(h) for h in ("meta_hash", "content_hash")})
    listed = rows.select("system", "commit_seq").distinct().join(small(c.imports("system", "commit_seq").distinct()), ["system", "commit_seq"], "left_semi")
    heads = listed.groupBy("system").agg(F.max("commit_seq").alias("commit_seq"))
    rows = rows.join(F.broadcast(heads), ["system", "commit_seq"])  # a row a system
    return rows.groupBy("system", "commit_seq", *KEY).agg(F.min("name").alias("name"), F.min("meta_hash").alias("meta_hash"), F.min("content_hash").alias("content_hash"))


def previous_imports(c: Catalog, evals: DataFrame) -> DataFrame:
    """``(system, commit_seq, previous_seq)``: the system's import before an evaluation."""
    heads = evals.select("system", "commit_seq").distinct()
    earlier = c.imports("commit_seq", "system").select("system", F.col("commit_seq").alias("_seq")).distinct()
    found = heads.join(earlier, "system").where(F.col("_seq") < F.col("commit_seq")).groupBy("system", "commit_seq").agg(F.max("_seq").alias("previous_seq"))
    return heads.join(found, ["system", "commit_seq"], "left")


def missing_packages(c: Catalog, evals: DataFrame) -> DataFrame:
    """``(name_key, name)`` of names the catalog lacks, the first spelling of each."""
    new = evals.select("name_key", "name").join(c.packages("name_key"), "name_key", "left_anti")
    return new.groupBy("name_key").agg(F.min("name").alias("name"))


def missing_versions(c: Catalog, evals: DataFrame) -> DataFrame:
    """``(package_id, name_key, version)`` that known packages lack."""
    wanted = evals.select("name_key", "version").distinct().join(c.packages("package_id", "name_key"), "name_key")
    return wanted.join(c.versions("package_id", "version"), ["package_id", "version"], "left_anti").select("package_id", "name_key", "version")


def missing_meta(c: Catalog, evals: DataFrame) -> DataFrame:
    known = c.meta("meta_hash").select(F.lower("meta_hash").alias("meta_hash"))
    return evals.select("meta_hash").where(F.col("meta_hash").isNotNull()).distinct().join(known, "meta_hash", "left_anti")


def listed_variants(c: Catalog, evals: DataFrame, how: str = "inner") -> DataFrame:
    """The rows of evaluations with their version ids and, where they exist, their variants."""
    ids = evals.join(c.packages("package_id", "name_key"), "name_key").join(c.versions("version_id", "package_id", "version"), ["package_id", "version"])
    old = c.variants("variant_id", "version_id", "system", "attr_path", "commit_seq", "content_hash").select("variant_id", "version_id", "system", "attr_path", F.lower("content_hash").alias("old_hash"), F.col("commit_seq").alias("old_seq"))
    return ids.join(old, ["version_id", "system", "attr_path"], how)


def changed_variants(c: Catalog, evals: DataFrame) -> DataFrame:
    """``(system, *KEY, variant_id)`` of variants that are new (no id) or whose content differs."""
    rows = listed_variants(c, evals, "left")
    return rows.where(F.col("variant_id").isNull() | (F.col("old_hash") != F.col("content_hash"))).select("system", *KEY, "variant_id")


def change_ratios(changed: DataFrame, evals: DataFrame, previous: DataFrame) -> DataFrame:
    """``(system, scanned, changed, warn)``: a first import never warns."""
    counts = evals.groupBy("system").agg(F.count(F.lit(1)).alias("scanned")).join(changed.groupBy("system").agg(F.count(F.lit(1)).alias("changed")), "system", "left")
    counts = counts.join(previous.select("system", "previous_seq"), "system").withColumn("changed", F.coalesce("changed", F.lit(0)))
    warn = F.col("previous_seq").isNotNull() & (F.col("changed") / F.col("scanned") > CHANGE_RATIO)
    return counts.select("system", "scanned", "changed", warn.alias("warn"))


def ranges_to_close(c: Catalog, evals: DataFrame) -> DataFrame:
    """``(variant_id, first_seq, last_seq)``: open ranges whose variant an evaluation of its system no longer lists, ended at the import before."""
    heads = previous_imports(c, evals).where(F.col("previous_seq").isNotNull())
    mine = c.variants("variant_id", "version_id", "system", "attr_path").join(small(heads.select("system", "previous_seq")), "system")
    open_ = c.ranges("variant_id", "first_seq", "last_seq").where(F.col("last_seq").isNull()).select("variant_id", "first_seq").join(mine, "variant_id")
    keyed = open_.join(c.versions("version_id", "package_id", "version"), "version_id").join(c.packages("package_id", "name_key"), "package_id")
    gone = keyed.join(evals.select("system", *KEY), ["system", *KEY], "left_anti")
    return gone.select("variant_id", "first_seq", F.col("previous_seq").alias("last_seq")).distinct()


def ranges_to_open(c: Catalog, evals: DataFrame) -> DataFrame:
    """``(variant_id, first_seq)``: listed variants without an open range."""
    listed = listed_variants(c, evals).select("variant_id", F.col("commit_seq").alias("first_seq")).distinct()
    open_ = c.ranges("variant_id", "last_seq").where(F.col("last_seq").isNull()).select("variant_id")
    return listed.join(open_, "variant_id", "left_anti").join(c.ranges("variant_id", "first_seq"), ["variant_id", "first_seq"], "left_anti")


def merged_ranges(c: Catalog, evals: DataFrame) -> DataFrame:
    """The table of ranges after an import of ``evals``."""
    closed = ranges_to_close(c, evals).withColumnRenamed("last_seq", "_closed")
    kept = c.ranges().join(closed, ["variant_id", "first_seq"], "left").withColumn("last_seq", F.coalesce("last_seq", "_closed")).drop("_closed")
    opened = ranges_to_open(c, evals).withColumns({"last_seq": F.lit(None).cast("int"), "seeded": F.lit(False), "backfill_last_seq": F.lit(None).cast("int")})
    return kept.select("variant_id", "first_seq", "last_seq", "seeded", "backfill_last_seq").unionByName(opened)


def upserted_variants(c: Catalog, rows: DataFrame, conditional: bool = False) -> DataFrame:
    """``(version_id, system, attr_path, commit_seq, content_hash)`` after ``rows`` of the same columns are written over the variants.

    ``conditional`` is the rule of late history: a row only replaces an older one, and the same content moves its date back.
    """
    key = ["version_id", "system", "attr_path"]
    old = c.variants(*key, "commit_seq", "content_hash").select(*key, F.col("commit_seq").alias("_seq"), F.lower("content_hash").alias("_hash"))
    new = first_per_key(rows.select(*key, "commit_seq", F.lower("content_hash").alias("content_hash")), key, [F.desc("commit_seq"), F.desc("content_hash")])
    both = old.join(new, key, "full")
    takes = F.col("commit_seq").isNotNull()
    if conditional:
        later, same = F.col("_seq") < F.col("commit_seq"), (F.col("_hash") == F.col("content_hash")) & (F.col("commit_seq") < F.col("_seq"))
        takes = takes & (F.col("_seq").isNull() | later | F.coalesce(same, F.lit(False)))
    pick = lambda n, o: F.when(takes, F.col(n)).otherwise(F.col(o)).alias(n)
    return both.select(*key, pick("commit_seq", "_seq"), pick("content_hash", "_hash"))


def search_terms_of(c: Catalog, evals: DataFrame) -> DataFrame:
    """``(package_id, name, attr_path, top_level_attr)`` that an import adds to the searchable terms."""
    rows = evals.select("name_key", "attr_path").distinct().join(c.packages(), "name_key")
    terms = rows.select("package_id", "name", "attr_path", F.when(~F.col("attr_path").contains("."), F.col("attr_path")).alias("top_level_attr")).distinct()
    return terms.join(c.search_terms.select("name", "attr_path"), ["name", "attr_path"], "left_anti").select("package_id", "name", "attr_path", "top_level_attr")


# ---------------------------------------------------------------- history filled in afterwards


def staged_ranges(c: Catalog) -> DataFrame:
    """``(variant_id, system, first_seq, last_seq, next_seq)`` of stage_backfill_ranges, keys resolved to variants."""
    rows = c.raw("stage_backfill_ranges").distinct().join(c.packages("package_id", "name_key"), "name_key")
    rows = rows.join(c.versions("version_id", "package_id", "version"), ["package_id", "version"])
    rows = rows.join(c.variants("variant_id", "version_id", "system", "attr_path"), ["version_id", "system", "attr_path"])
    return materialised(rows.select("variant_id", "system", "first_seq", "last_seq", "next_seq").distinct())  # needed more than once


def covered_points(c: Catalog, staged: DataFrame) -> DataFrame:
    """``(variant_id, first_seq)`` of seeded points that lie within a staged range."""
    points = c.ranges("variant_id", "first_seq", "seeded").where("seeded").select("variant_id", "first_seq").distinct()
    spans = staged.select("variant_id", F.col("first_seq").alias("_a"), F.col("last_seq").alias("_b"))
    inside = points.join(spans, "variant_id").where((F.col("_a") <= F.col("first_seq")) & (F.col("first_seq") <= F.col("_b")))
    return inside.select("variant_id", "first_seq").distinct()


def overlapping_ranges(c: Catalog, staged: DataFrame, windows: DataFrame | None = None, taken_back: bool = False) -> DataFrame:
    """``(variant_id, first_seq, last_seq, live_first, live_last, written_by)``: staged ranges that meet a live one without being it.

    With ``taken_back``, stale parts of earlier backfills count as taken back already.
    """
    live = _without_stale(c, staged, windows) if taken_back else c.ranges()
    live = live.where(~F.coalesce("seeded", F.lit(False)))
    live = live.select("variant_id", F.col("first_seq").alias("live_first"), F.col("last_seq").alias("live_last"), F.col("backfill_last_seq").alias("_part")).distinct()
    both = staged.select("variant_id", "first_seq", "last_seq").join(live, "variant_id")
    own = (F.col("live_first") == F.col("first_seq")) & F.coalesce(F.col("_part") == F.col("last_seq"), F.lit(False))
    meets = (F.col("live_first") <= F.col("last_seq")) & (F.coalesce("live_last", F.lit(OPEN_END)) >= F.col("first_seq"))
    by = F.when(F.col("_part").isNull(), "forward import").otherwise("earlier backfill")  # fixed values
    return both.where(~own & meets).select("variant_id", "first_seq", "last_seq", "live_first", "live_last", by.alias("written_by"))


def stale_parts(c: Catalog, staged: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """``(variant_id, first_seq, whole)``: parts an earlier backfill wrote in the staged windows that the staged ranges don't repeat.

    ``windows (system, first_seq, last_seq)`` are what the staged ranges of a system span, if not given.
    ``whole`` ones are to be deleted, of the others only the filled-in part.
    """
    windows = (staged if windows is None else windows).groupBy("system").agg(F.min("first_seq").alias("_from"), F.max("last_seq").alias("_to"))
    own = c.ranges().where(F.col("backfill_last_seq").isNotNull() & ~F.coalesce("seeded", F.lit(False)))
    own = own.join(c.variants("variant_id", "system"), "variant_id").join(staged.select("variant_id"), "variant_id", "left_semi")
    own = own.join(F.broadcast(windows), "system").where((F.col("_from") <= F.col("first_seq")) & (F.col("backfill_last_seq") <= F.col("_to")))  # a row a system
    exact = staged.select("variant_id", "first_seq", F.col("last_seq").alias("backfill_last_seq"))
    stale = own.join(exact, ["variant_id", "first_seq", "backfill_last_seq"], "left_anti")
    return stale.select("variant_id", "first_seq", F.coalesce(F.col("last_seq") == F.col("backfill_last_seq"), F.lit(False)).alias("whole"))


def _without_stale(c: Catalog, staged: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """The table of ranges with stale parts taken back: whole ones go, extended ones start where the forward import had started them."""
    ranges = c.ranges()
    stale = materialised(stale_parts(c, staged, windows).distinct())
    if stale.isEmpty():
        return ranges
    marked = ranges.join(stale, ["variant_id", "first_seq"], "left")
    reaches = F.col("last_seq").isNull() | (F.col("last_seq") > F.col("backfill_last_seq"))
    extended = marked.where(~F.col("whole") & reaches).join(c.variants("variant_id", "system"), "variant_id")
    back = next_point(extended, "system", "backfill_last_seq", c.imports("system", "commit_seq"), "commit_seq", "_start").withColumns({"first_seq": F.col("_start"), "backfill_last_seq": F.lit(None).cast("int")})
    kept = marked.where(F.col("whole").isNull() | (~F.col("whole") & ~reaches))
    return kept.select(*ranges.columns).unionByName(back.select(*ranges.columns))


def backfilled_ranges(c: Catalog, staged: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """The table of ranges after the staged ones are applied: stale parts are taken back, covered points go, a range that a staged one runs into starts earlier, the rest is added."""
    live = _without_stale(c, staged, windows).join(covered_points(c, staged).withColumn("_covered", F.lit(True)), ["variant_id", "first_seq"], "left")
    live = live.where(~(F.coalesce("seeded", F.lit(False)) & F.coalesce("_covered", F.lit(False)))).drop("_covered")
    runs = staged.where(F.col("next_seq").isNotNull()).groupBy("variant_id", F.col("next_seq").alias("first_seq")).agg(F.min(F.struct("first_seq", "last_seq")).alias("_s"))
    joined = live.join(runs.select("variant_id", "first_seq", F.col("_s.first_seq").alias("_first"), F.col("_s.last_seq").alias("_last")), ["variant_id", "first_seq"], "left")
    extends = F.col("_first").isNotNull() & ~F.coalesce("seeded", F.lit(False))
    part = F.when(extends, F.coalesce("backfill_last_seq", "_last")).otherwise(F.col("backfill_last_seq"))
    joined = joined.select("variant_id", F.when(extends, F.col("_first")).otherwise(F.col("first_seq")).alias("first_seq"), "last_seq", "seeded", part.alias("backfill_last_seq"))
    added = staged.groupBy("variant_id", "first_seq").agg(F.max("last_seq").alias("last_seq")).join(joined.select("variant_id", "first_seq"), ["variant_id", "first_seq"], "left_anti")
    return joined.unionByName(added.withColumns({"seeded": F.lit(False), "backfill_last_seq": F.col("last_seq")}))


def incomplete_evaluations(c: Catalog, delivered: DataFrame, systems: list[str], since, through: int) -> DataFrame:
    """``(commit_seq, system, problem)``: evaluations of a window that are missing, and delivered ones outside it (extra)."""
    window = c.commits("seq", "committed_at").where((F.col("committed_at") >= F.lit(since)) & (F.col("seq") <= through)).select(F.col("seq").alias("commit_seq"))
    wanted = c.imports("commit_seq", "system").where(F.col("system").isin(systems)).select("commit_seq", "system").distinct().join(window, "commit_seq", "left_semi")
    have = delivered.select("commit_seq", "system").distinct()
    on = ["commit_seq", "system"]
    missing = wanted.join(have, on, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(have.join(wanted, on, "left_anti").withColumn("problem", F.lit("extra")))


def seeded_ranges(c: Catalog) -> DataFrame:
    """``(row_id, system, first_seq, last_seq)``: the seed's records as point ranges at the commit they refer to."""
    rows = c.raw("variant_rows").select("row_id", "system", F.regexp_replace(F.lower("commit_hash"), r"^\s+|\s+$", "").alias("_hash")).distinct()
    commits = c.commits("seq", "hash").select(F.lower("hash").alias("_hash"), "seq")
    return rows.join(commits, "_hash").select("row_id", "system", F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"))


def numbered_commits(commits: DataFrame) -> DataFrame:
    """``(hash, seq)``: commits in the order of their time, then hash. Numbers come from one task: a row a commit, as the timeline has."""
    return commits.select("hash", "committed_at").distinct().select("hash", F.row_number().over(Window.orderBy("committed_at", "hash")).alias("seq"))
