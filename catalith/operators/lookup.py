"""Looking up variants by name or attribute path, and choosing versions among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.constraint import CONSTRAINT_COLUMNS, constraint_row, parse_constraint, prefix_with_boundary, satisfies, satisfies_row
from catalith.functions.names import name_key_of
from catalith.session import materialised
from catalith.sources.catalog import Catalog, given, literal_rows

OPEN_END = 2147483647
#: Rows that a search lists at most unless the caller lifts it.
ROWS = 1000


def variants_of(c: Catalog, term: str) -> DataFrame:
    """``(variant_id, version_id)`` of what goes by a name (whatever its case) or lies at an attribute path (exactly).

    Two walks and a union, so that either side keeps its own pushed filter; copies of a record are made one among the hits alone.
    """
    v = c.raw("variants").withColumnRenamed("id", "variant_id")
    named = c.packages_named(given(literal_rows(c.spark, [(name_key_of(term),)], "name_key string"), 1)).select("package_id")
    owned = c.raw("versions").select(F.col("id").alias("version_id"), "package_id").join(named, "package_id", "left_semi").select("version_id")
    by_name = v.select("variant_id", "version_id").join(owned, "version_id", "left_semi").select("variant_id", "version_id")
    by_path = v.where(F.col("attr_path") == term).select("variant_id", "version_id")
    return by_name.unionByName(by_path).distinct()


def result_rows(c: Catalog, variants: DataFrame) -> DataFrame:
    """The wide row that queries return: variants with their version, package, metadata and commit of last change."""
    commits = c.commits("seq", "hash", "committed_at").select(F.col("seq").alias("commit_seq"), F.col("hash").alias("commit_hash"), F.col("committed_at").alias("last_updated"))
    meta = c.meta("meta_id", "summary", "description", "homepage", "license", "platforms")
    packages = c.raw("packages").select(F.col("id").alias("package_id"), "name").distinct()
    wide = variants.join(c.versions("version_id", "package_id", "version", "sort_key", "prerelease"), "version_id").join(packages, "package_id").join(meta, "meta_id").join(commits, "commit_seq")
    columns = ["name", "version", "commit_hash", "last_updated", "store_hash", "store_name", F.col("version").alias("store_version"), "meta_name", "meta_version", "attr_path", "system", "program"]
    columns += ["summary", "description", "homepage", "license", "broken", "insecure", "prerelease", "platforms"]
    return wide.select("variant_id", "version_id", "package_id", "sort_key", *columns)


def release_order(key: str = "sort_key", version: str = "version", ident: str = "version_id") -> list[Column]:
    """Newest first; version and id break ties."""
    return [F.desc_nulls_last(key), F.asc(version), F.asc(ident)]


def scoped(rows: DataFrame, system: str | None = None, no_prerelease: bool = False) -> DataFrame:
    if no_prerelease:
        rows = rows.where(~F.col("prerelease"))
    return rows.where(F.col("system") == system) if system else rows


def versions_by_name(c: Catalog, term: str, system: str | None = None, no_prerelease: bool = False) -> DataFrame:
    """Every version of a name or attribute path, newest first, then by system and path."""
    hit = variants_of(c, term).select("variant_id")
    rows = scoped(result_rows(c, c.shown_variants(among=hit)), system, no_prerelease)
    return rows.orderBy(*release_order(), "system", "attr_path")


def last_seen(ranges: DataFrame) -> DataFrame:
    """``(variant_id, last_seen)``: the newest place a variant was present in; an open range is newest of all, seeded points don't count."""
    own = ranges.where(~F.coalesce("seeded", F.lit(False)))
    return own.groupBy("variant_id").agg(F.max(F.coalesce("last_seq", F.lit(OPEN_END))).alias("last_seen"))


def version_standing(c: Catalog, system: str | None = None, among: DataFrame | None = None) -> DataFrame:
    """``(version_id, working, last_seen)`` of each version (or of those ``among``) with variants in scope: any of them not broken, newest presence."""
    v = c.variants("variant_id", "version_id", "system", "broken", among=among)
    v = v.where(F.col("system") == system) if system else v
    seen = v.join(last_seen(c.ranges("variant_id", "last_seq", "seeded", among=None if among is None else v.select("variant_id"))), "variant_id", "left")
    return seen.groupBy("version_id").agg(F.bool_or(~F.coalesce("broken", F.lit(False))).alias("working"), F.max(F.coalesce("last_seen", F.lit(0))).alias("last_seen"))


def latest_versions(c: Catalog, by: str = "package_id", system: str | None = None, prereleases: str = "last", among: DataFrame | None = None) -> DataFrame:
    """``(by, version_id, version, prerelease)``: the version ``latest`` means for every package, or every ``name_key``.

    In order: no prerelease (``prereleases="last"``; ``"never"`` leaves them out, ``"any"`` ignores the mark), a variant that isn't broken, newest
    presence, highest version; then the smaller version string and id. A group without variants in scope has no row. ``among (package_id)``
    leaves other packages unread.
    """
    versions = c.versions("version_id", "package_id", "version", "sort_key", "prerelease", among=among)
    rows = version_standing(c, system, None if among is None else versions.select("version_id")).join(versions, "version_id")
    if by == "name_key":
        rows = rows.join(c.packages("package_id", "name_key"), "package_id")
    if prereleases == "never":
        rows = rows.where(~F.col("prerelease"))
    order = ([F.asc("prerelease")] if prereleases == "last" else []) + [F.desc("working"), F.desc("last_seen"), *release_order()]
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("_place") == 1).select(by, "version_id", "version", "prerelease")


def requested(c: Catalog, rows: list[tuple], schema: str) -> tuple[DataFrame, DataFrame]:
    """A caller's list of ``(ord, wanted, name_key, ...)`` as a table, and ``(ord, variant_id, version_id)`` of what each means by package name or attribute path."""
    wanted = given(literal_rows(c.spark, rows, schema), len(rows))
    v = c.raw("variants").select(F.col("id").alias("variant_id"), "version_id", "attr_path")
    named = c.packages_named(wanted.select("name_key", "ord")).join(c.raw("versions").select(F.col("id").alias("version_id"), "package_id"), "package_id").select("ord", "version_id").distinct()
    hits = v.join(named, "version_id").select("ord", "variant_id", "version_id")
    hits = hits.unionByName(v.join(wanted.select("ord", F.col("wanted").alias("attr_path")), "attr_path").select("ord", "variant_id", "version_id")).distinct()
    return wanted, materialised(hits)  # needed more than once


def latest_for(c: Catalog, names: list[str]) -> DataFrame:
    """``(ord, wanted, version, systems, attr_path, last_updated)`` in the order of a list of names; a miss has nulls.

    A wanted name is met by package name or attribute path. Only what is met is read on.
    """
    wanted, hits = requested(c, [(k, n, name_key_of(n)) for k, n in enumerate(names, 1)], "ord int,wanted string,name_key string")
    ids = hits.select("version_id").distinct()
    own = c.variants("variant_id", "version_id", "system", "attr_path", "commit_seq", "broken", among=ids)
    working = own.groupBy("version_id").agg(F.bool_or(~F.coalesce("broken", F.lit(False))).alias("working"))
    rows = hits.join(last_seen(c.ranges("variant_id", "last_seq", "seeded", among=hits.select("variant_id"))), "variant_id", "left")
    rows = rows.join(working, "version_id", "left").join(c.versions("version_id", "version", "sort_key", "prerelease", among=ids), "version_id")
    seen, works = F.coalesce("last_seen", F.lit(0)), F.coalesce("working", F.lit(False))
    first = F.row_number().over(Window.partitionBy("ord").orderBy(F.asc("prerelease"), works.desc(), seen.desc(), *release_order()))
    best = rows.withColumn("_place", first).where(F.col("_place") == 1).select("ord", "version_id", "version")
    commits = c.commits("seq", "committed_at").select(F.col("seq").alias("commit_seq"), "committed_at")
    detail = own.select("version_id", "system", "attr_path", "commit_seq").join(best, "version_id").join(commits, "commit_seq")
    facts = detail.groupBy("ord", "version").agg(F.array_join(F.array_sort(F.collect_set("system")), ",").alias("systems"), F.min("attr_path").alias("attr_path"), F.max("committed_at").alias("last_updated"))
    return wanted.select("ord", "wanted").join(facts, "ord", "left").orderBy("ord")


def constrained_versions(c: Catalog, requests: list[tuple[str, str]]) -> DataFrame:
    """``(ord, wanted, constraint, version_id, version)``: for each (name, constraint) the highest version that meets it.

    A constraint that is a range of semantic versions is met by those; if none is, or the text is no range, by versions
    it is a prefix of up to a dot or dash. Every candidate counts, however many there are. A request that nothing meets has nulls.
    The parsed bounds are columns of the request table, so the plan is the same for any number of requests.
    """
    rows = [(k, n, name_key_of(n), t, *constraint_row(parse_constraint(t))) for k, (n, t) in enumerate(requests, 1)]
    wanted, hits = requested(c, rows, f"ord int,wanted string,name_key string,constraint string,{CONSTRAINT_COLUMNS}")
    ids = hits.select("ord", "version_id").distinct()
    parts = [f"semver_{x}" for x in ("major", "minor", "patch", "pre")]
    candidates = ids.join(c.versions("version_id", "version", "sort_key", *parts, among=ids.select("version_id")), "version_id").join(wanted, "ord")
    met = candidates.withColumn("_fits", satisfies_row(*map(F.col, parts))).where(F.col("_fits") | prefix_with_boundary(F.col("version"), F.col("constraint")))
    first = F.row_number().over(Window.partitionBy("ord").orderBy(F.desc("_fits"), *release_order()))
    best = met.withColumn("_place", first).where(F.col("_place") == 1).select("ord", "version_id", "version")
    return wanted.select("ord", "wanted", "constraint").join(best, "ord", "left").orderBy("ord")


def newest_releases(c: Catalog, count: int | None, among: DataFrame | None = None) -> DataFrame:
    """``(package_id, place, version, systems)``: the newest releases that have variants, all of them for None; of the packages ``among`` only, if given."""
    versions = c.versions("version_id", "package_id", "version", "sort_key", among=among)
    variants = c.variants("version_id", "system", among=None if among is None else versions.select("version_id"))
    systems = variants.groupBy("version_id").agg(F.array_join(F.array_sort(F.collect_set("system")), ",").alias("systems"))
    rows = versions.join(systems, "version_id").withColumn("place", F.row_number().over(Window.partitionBy("package_id").orderBy(*release_order())))
    return (rows if count is None else rows.where(F.col("place") <= count)).select("package_id", "place", "version", "systems")


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") == 1).drop("_place")


def consecutive_groups(rows: DataFrame, scope: list[str], order: list[Column], key: str, out: str = "run") -> DataFrame:
    """Adds the number of the run of equal keys that a row belongs to; a key that comes back begins a new run."""
    w = Window.partitionBy(*scope).orderBy(*order)
    new = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.col(key).eqNullSafe(F.lag(key).over(w))).cast("int"))
    return rows.withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def dispatch(c: Catalog, *, phrase: str = "", name: str = "", version: str = "", system: str = "", no_prerelease: bool = False, releases: str | None = None, limit: int | None = ROWS) -> DataFrame:
    """One entry for the kinds of search: a phrase alone, a name alone, a name with a version or constraint."""
    from catalith.functions.names import normalized
    from catalith.operators.phrase import search_phrase

    phrase, name, version, system = (normalized(x) for x in (phrase, name, version, system.lower()))
    if phrase and not name:
        return search_phrase(c, phrase, latest_only=version == "latest", releases=releases, rows=limit)
    if name and not version:
        return versions_by_name(c, name, system or None, no_prerelease)
    if name and version:
        return by_name_and_version(c, name, version, system or None, no_prerelease, limit=limit)
    raise ValueError("unsupported search: neither a phrase nor a name")


def by_name_and_version(c: Catalog, name: str, version: str, system: str | None = None, no_prerelease: bool = False, prereleases_last: bool = False, limit: int | None = ROWS) -> DataFrame:
    """All rows in scope of the one version that a name and ``latest`` or a constraint mean, by system and path; at most ``limit``, all for None."""
    columns = ["version_id", "package_id", "version", "sort_key", "prerelease", *(f"semver_{x}" for x in ("major", "minor", "patch", "pre"))]
    found = materialised(variants_of(c, name))  # needed more than once
    ids = found.select("version_id").distinct()
    own = c.variants("variant_id", "version_id", "system", "broken", among=ids)
    hits = scoped(own.join(found.select("variant_id"), "variant_id", "left_semi").join(c.versions(*columns, among=ids), "version_id"), system, no_prerelease)
    if version == "latest":
        within = own.where(F.col("system") == system) if system else own
        working = within.groupBy("version_id").agg(F.bool_or(~F.coalesce("broken", F.lit(False))).alias("working"))
        order = [F.asc("prerelease")] * prereleases_last + [F.desc("working"), F.coalesce("last_seen", F.lit(0)).desc(), *release_order()]
        ranked = hits.join(last_seen(c.ranges("variant_id", "last_seq", "seeded", among=found.select("variant_id"))), "variant_id", "left").join(working, "version_id")
    else:
        parsed = parse_constraint(version)
        fits = satisfies(parsed, *(F.col(f"semver_{x}") for x in ("major", "minor", "patch", "pre"))) if parsed else F.lit(False)
        ranked = hits.withColumn("_fits", fits).where(F.col("_fits") | prefix_with_boundary(F.col("version"), version))
        order = [F.desc("_fits"), *release_order()]
    best = F.broadcast(ranked.orderBy(*order).limit(1).select("version_id"))  # one row
    rows = scoped(result_rows(c, c.shown_variants(among=best)), system, no_prerelease).orderBy("system", "attr_path")
    return rows if limit is None else rows.limit(limit)


def resolve(c: Catalog, name: str, version: str, system: str | None = None) -> DataFrame:
    """``by_name_and_version``; at ``latest`` prereleases come last, so they count only when there is nothing else."""
    if version == "latest":
        return by_name_and_version(c, name, version, system, prereleases_last=True)
    return dispatch(c, name=name, version=version, system=system or "")
