"""Bookkeeping of the catalog: counts, imports, commits and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.version import is_prerelease
from catalith.session import materialised
from catalith.sources.catalog import Catalog

#: Names of one page of the site map.
PAGE = 50_000
COUNTED = ["commits", "commit_systems", "packages", "versions", "variants", "variant_ranges", "meta"]


def row_counts(c: Catalog) -> DataFrame:
    """``(table_name, n_rows)``, copies of a record counting once."""
    parts = [c.raw(t).distinct().agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in COUNTED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def system_status(c: Catalog) -> DataFrame:
    """``(system, imports, newest_seq, behind, nix_version, last_import_at, commit_hash, committed_at)`` of each system."""
    by = c.imports("commit_seq", "system", "imported_at", "nix_version").groupBy("system").agg(
        F.count_distinct("commit_seq").alias("imports"),
        F.max("commit_seq").alias("newest_seq"),
        F.max_by("nix_version", F.struct("commit_seq", "imported_at")).alias("nix_version"),
        F.max("imported_at").alias("last_import_at"),
    )
    head = c.commits("seq").agg(F.max("seq").alias("head"))
    commits = c.commits("seq", "hash", "committed_at").select(F.col("seq").alias("newest_seq"), F.col("hash").alias("commit_hash"), "committed_at")
    rows = by.join(commits, "newest_seq").join(F.broadcast(head))  # one row
    return rows.select("system", "imports", "newest_seq", (F.col("head") - F.col("newest_seq")).alias("behind"), "nix_version", "last_import_at", "commit_hash", "committed_at")


def commit_ends(c: Catalog) -> DataFrame:
    """``(place, seq, hash, committed_at)`` of the oldest and the newest commit."""
    one = F.struct("seq", "hash", "committed_at")
    ends = c.commits("seq", "hash", "committed_at").agg(F.min(one).alias("oldest"), F.max(one).alias("newest"))
    return ends.select(F.expr("stack(2, 'oldest', oldest, 'newest', newest) as (place, c)")).select("place", "c.seq", "c.hash", "c.committed_at")


def incomplete_commits(c: Catalog, systems: list[str]) -> DataFrame:
    """``(seq, hash, missing)``: commits that some of the systems weren't imported for."""
    expected = F.explode(F.array(*(F.lit(s) for s in systems))).alias("system")
    matrix = c.commits("seq", "hash").select("seq", "hash", expected)
    have = c.imports("commit_seq", "system").select(F.col("commit_seq").alias("seq"), "system").distinct()
    lacking = matrix.join(have, ["seq", "system"], "left_anti")
    return lacking.groupBy("seq", "hash").agg(F.array_join(F.array_sort(F.collect_set("system")), ",").alias("missing"))


def page_after(c: Catalog, after: int, limit: int = PAGE) -> DataFrame:
    """``(package_id, name)`` of the packages after an id, in the order of ids."""
    return c.packages("package_id", "name").where(F.col("package_id") > after).orderBy("package_id").limit(limit)


def page_start(c: Catalog, page: int, size: int = PAGE) -> DataFrame:
    """``(after)``: the id after which a page begins: 0 for the first, none past the end."""
    if page <= 1:
        return c.spark.range(1).select(F.lit(0).alias("after"))
    ids = c.raw("packages").select("id").distinct()
    return ids.orderBy("id").offset((page - 1) * size - 1).limit(1).select(F.col("id").alias("after"))


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds the number of each row, from 1, in a total order; every row has one, equal rows in no order of theirs.

    The rows are sorted by range and written once (``materialised``), so that the numbers of a piece and the counts of the
    pieces before it come from the same rows; no task sees all rows, and the second pass shuffles nothing.
    """
    pieces = materialised(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = pieces.withColumn("_at", F.monotonically_increasing_id())  # the piece in the upper 31 bits, the place in it in the lower 33
    placed = placed.withColumns({"_piece": F.shiftright("_at", 33), "_own": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = placed.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_piece", F.coalesce(F.sum("_n").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = placed.join(F.broadcast(before), "_piece")  # a row a piece
    return placed.withColumn(out, F.col("_before") + F.col("_own") + 1).drop("_piece", "_at", "_own", "_before")


def batches(rows: DataFrame, order: list[str], size: int, out: str = "batch") -> DataFrame:
    """Adds the number of the batch of ``size`` rows that a row falls into, in a total order."""
    return numbered(rows, order, out).withColumn(out, F.floor((F.col(out) - 1) / size).cast("int"))


def pending_commits(c: Catalog, releases: DataFrame, limit: int | None = 4) -> DataFrame:
    """``(short_hash, number)``: the oldest listed releases newer than everything imported, at most ``limit``, all for None.

    ``releases (short_hash, number)`` abbreviate hashes to various lengths; known commits are cut to each of them.
    """
    lengths = releases.select(F.length("short_hash").alias("n")).distinct().join(F.broadcast(c.spark.range(1).select(F.lit(1).alias("_one"))))
    known = c.commits("hash").distinct().join(F.broadcast(lengths.select("n"))).select(F.expr("left(hash, n)").alias("short_hash")).distinct()
    head = releases.join(known, "short_hash", "left_semi").agg(F.coalesce(F.max("number"), F.lit(0)).alias("head"))
    new = releases.join(known, "short_hash", "left_anti").join(F.broadcast(head)).where(F.col("number") > F.col("head"))
    new = new.orderBy("number").select("short_hash", "number")
    return new if limit is None else new.limit(limit)


def with_backfill(incomplete: DataFrame, pending: DataFrame, limit: int | None, key: str = "hash") -> DataFrame:
    """Incomplete commits first, then pending ones that aren't among them, both in their ``number``'s order, at most ``limit``, all for None."""
    both = incomplete.select(key, "number").withColumn("turn", F.lit(0)).unionByName(pending.select(key, "number").withColumn("turn", F.lit(1)).join(incomplete.select(key), key, "left_anti"))
    both = both.orderBy("turn", "number")
    return both if limit is None else both.limit(limit)


def canonical_spellings(c: Catalog) -> DataFrame:
    """``(name_key, spelling, spellings)``: the spelling most versions use, the smallest of equals."""
    uses = c.packages().join(c.versions("package_id"), "package_id").groupBy("name_key", "name").agg(F.count(F.lit(1)).alias("n"))
    best = uses.groupBy("name_key").agg(F.min(F.struct((-F.col("n")).alias("n"), "name")).alias("b"), F.count(F.lit(1)).alias("spellings"))
    return best.select("name_key", F.col("b.name").alias("spelling"), "spellings")


def order_divergences(rows: DataFrame, group: str, old: str, new: str, ident: str) -> DataFrame:
    """``(ident, before)``: items that some item before them in the old order should follow in the new, with the foremost such item's new place.

    Instead of all pairs each item is held against the running maximum of its group: it is out of order exactly if that is greater.
    """
    w = Window.partitionBy(group).orderBy(old, new, ident).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_max", F.max(new).over(w)).where(F.col("_max") > F.col(new)).select(ident, F.col("_max").alias("before"))


def prerelease_divergences(c: Catalog) -> DataFrame:
    """``(version_id, version, stored, computed)``: versions whose stored mark of a prerelease isn't what their text says."""
    rows = c.versions("version_id", "version", "prerelease").select("version_id", "version", F.col("prerelease").alias("stored"), is_prerelease(F.col("version")).alias("computed"))
    return rows.where(~F.col("stored").eqNullSafe(F.col("computed")))
