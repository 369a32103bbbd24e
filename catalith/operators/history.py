"""Presence and content over the timeline of imported evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.operators.intervals import OPEN_END, timeline_of
from catalith.operators.lookup import first_per_key
from catalith.sources.catalog import Catalog, small

KEY = ["name_key", "version", "attr_path"]


def evaluated_rows(c: Catalog) -> DataFrame:
    """``(system, commit_seq, *KEY, content_hash)`` of every evaluated variant, once; stubs without a store path are left out."""
    rows = c.raw("stage_variants").where(F.col("store_hash") != "")
    return rows.groupBy("system", "commit_seq", *KEY).agg(F.max(F.lower("content_hash")).alias("content_hash"))


def next_point(rows: DataFrame, scope: str, at: str, points: DataFrame, point: str, out: str) -> DataFrame:
    """Adds the smallest point of the scope beyond ``at``, null if there is none."""
    points = points.select(scope, F.col(point).alias(out)).where(F.col(scope).isNotNull() & F.col(out).isNotNull()).distinct()
    timeline = timeline_of(points, scope, out)
    ranked = points.select(scope, out, F.row_number().over(Window.partitionBy(scope).orderBy(out)).alias("_n"))
    rows = timeline.ranked(rows, scope, at, "_n", through=True).withColumn("_n", F.col("_n") + 1)
    return rows.join(F.broadcast(ranked) if timeline.fits else ranked, [scope, "_n"], "left").drop("_n")


def presence_runs(c: Catalog, rows: DataFrame) -> DataFrame:
    """``(system, *KEY, first_seq, last_seq, next_seq)``: runs of evaluations in a row that list a variant.

    Evaluations, not places of the timeline, are neighbours: one that wasn't made breaks no run. ``next_seq`` is the system's next
    imported place after the run.
    """
    evals = rows.select("system", "commit_seq").distinct()
    evals = evals.withColumn("_n", F.row_number().over(Window.partitionBy("system").orderBy("commit_seq")))
    keyed = rows.select("system", "commit_seq", *KEY).distinct().join(small(evals), ["system", "commit_seq"])
    run = F.col("_n") - F.row_number().over(Window.partitionBy("system", *KEY).orderBy("commit_seq"))
    runs = keyed.withColumn("_run", run).groupBy("system", *KEY, "_run").agg(F.min("commit_seq").alias("first_seq"), F.max("commit_seq").alias("last_seq"))
    imports = c.imports("system", "commit_seq")
    return next_point(runs.drop("_run"), "system", "last_seq", imports, "commit_seq", "next_seq").select("system", *KEY, "first_seq", "last_seq", "next_seq")


def content_first_seen(rows: DataFrame) -> DataFrame:
    """``(system, *KEY, content_hash, content_seq)``: the newest content of a variant and where it first appeared, gaps bridged."""
    w = Window.partitionBy("system", *KEY).orderBy("commit_seq")
    new = (~F.col("content_hash").eqNullSafe(F.lag("content_hash").over(w))).cast("int")
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("system", *KEY, "_run").agg(F.max("content_hash").alias("content_hash"), F.min("commit_seq").alias("content_seq"))
    return first_per_key(runs, ["system", *KEY], [F.desc("_run")]).drop("_run")


def dated_contents(c: Catalog) -> DataFrame:
    """The rows of stage_variants whose content is the newest of their variant, at the evaluation where it first appeared; one a variant."""
    first = content_first_seen(evaluated_rows(c)).select("system", *KEY, F.col("content_seq").alias("commit_seq"))
    held = c.raw("stage_variants").where(F.col("store_hash") != "").withColumns({h: F.lower(h) for h in ("meta_hash", "content_hash")})
    held = held.groupBy("system", "commit_seq", *KEY).agg(F.max_by(F.struct("meta_hash", "store_hash", "store_name", "broken", "insecure", "content_hash"), F.struct("content_hash", "store_hash", "meta_hash")).alias("_h"))
    return held.join(first, ["system", "commit_seq", *KEY], "left_semi").select("system", "commit_seq", *KEY, "_h.*")


def newest_common(intervals: DataFrame, entity: str, group: str, low: str, high: str) -> DataFrame:
    """``(entity, groups, seq)``: the newest place that lies in an interval of every group of an entity, null if there is none.

    A sweep: each group's intervals are made disjoint, and a running count tells how many groups are present where one ends.
    All steps stand on one shuffle by entity. Intervals that end before they begin, or lack an end, are none.
    """
    rows = intervals.select(F.col(entity).alias("_of"), F.col(group).alias("_in"), F.col(low).alias("_low"), F.col(high).alias("_high")).where(F.col("_low") <= F.col("_high"))
    own = Window.partitionBy("_of", "_in").orderBy("_low", "_high")
    met = F.max("_high").over(own.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("_low")
    rows = rows.repartition("_of").withColumn("_new", F.when(met, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.when(F.col("_island") == 1, 1).otherwise(0)
    merged = rows.groupBy("_of", "_in", "_island").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high")).withColumn("_first", first)
    both = F.array(F.struct(F.col("_low").alias("at"), F.lit(0).alias("ends"), F.col("_first").alias("first")), F.struct(F.col("_high").alias("at"), F.lit(1).alias("ends"), F.lit(0).alias("first")))
    events = merged.select("_of", F.explode(both).alias("_e")).select("_of", F.col("_e.at").alias("_at"), F.col("_e.ends").alias("_ends"), F.col("_e.first").alias("_first"))
    earlier = Window.partitionBy("_of").orderBy("_at", "_ends").rowsBetween(Window.unboundedPreceding, -1)
    present = F.sum(F.when(F.col("_ends") == 1, -1).otherwise(1)).over(earlier)
    swept = events.withColumns({"_present": present, "_groups": F.sum("_first").over(Window.partitionBy("_of"))})
    shared = F.max(F.when((F.col("_ends") == 1) & (F.col("_present") == F.col("_groups")), F.col("_at")))
    return swept.groupBy("_of").agg(F.max("_groups").alias("groups"), shared.alias("seq")).select(F.col("_of").alias(entity), "groups", "seq")


def live_spans(c: Catalog, versions: DataFrame | None = None) -> DataFrame:
    """``(version_id, system, first_seq, last_seq)``: where versions (all, or those of ``versions (version_id)``) are present on a system.

    Of each system the first attribute path counts, seeded points don't, an open range lasts to the system's newest import.
    """
    variants = c.variants("variant_id", "version_id", "system", "attr_path")
    variants = variants if versions is None else variants.join(versions.select("version_id").distinct(), "version_id", "left_semi")
    first = first_per_key(variants, ["version_id", "system"], [F.asc("attr_path"), F.asc("variant_id")])
    heads = c.imports("commit_seq", "system").groupBy("system").agg(F.max("commit_seq").alias("head"))
    own = c.ranges("variant_id", "first_seq", "last_seq", "seeded").where(~F.coalesce("seeded", F.lit(False))).select("variant_id", "first_seq", "last_seq")
    rows = own.join(first, "variant_id").join(F.broadcast(heads), "system")  # a row a system
    return rows.select("version_id", "system", "first_seq", F.coalesce("last_seq", "head").alias("last_seq")).where(F.col("first_seq") <= F.col("last_seq"))


def common_commits(c: Catalog, versions: DataFrame | None = None) -> DataFrame:
    """``(version_id, systems, commit_seq, commit_hash, committed_at)``: the newest commit at which a version exists on all the systems that have ``live_spans``.

    Versions that are present on fewer than two systems, or on none at one commit, have no row.
    """
    best = newest_common(live_spans(c, versions), "version_id", "system", "first_seq", "last_seq").where((F.col("groups") >= 2) & F.col("seq").isNotNull())
    commits = c.commits("seq", "hash", "committed_at").select(F.col("seq"), F.col("hash").alias("commit_hash"), "committed_at")
    return best.join(commits, "seq").select("version_id", F.col("groups").alias("systems"), F.col("seq").alias("commit_seq"), "commit_hash", "committed_at")


def at_common_commit(c: Catalog, rows: DataFrame) -> DataFrame:
    """Rows of ``result_rows`` with the commit and date of their version's common commit, on the systems that have live spans; others stay as they are."""
    versions = rows.select("version_id").distinct()
    new = common_commits(c, versions).select("version_id", F.col("commit_hash").alias("_hash"), F.col("committed_at").alias("_at"))
    new = new.join(live_spans(c, versions).select("version_id", "system").distinct(), "version_id")
    both = rows.join(new, ["version_id", "system"], "left")
    return both.withColumns({"commit_hash": F.coalesce("_hash", "commit_hash"), "last_updated": F.coalesce("_at", "last_updated")}).drop("_hash", "_at")


__all__ = ["OPEN_END", "at_common_commit", "common_commits", "content_first_seen", "dated_contents", "evaluated_rows", "live_spans", "newest_common", "next_point", "presence_runs"]
