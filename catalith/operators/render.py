"""Responses as nested values: what a row of a search, a version or a package reads like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.display import escape_html, iso, package_path, quoted, rfc3339, unix_seconds
from catalith.functions.paths import arch_os, supported
from catalith.operators import status
from catalith.operators.lookup import consecutive_groups, first_per_key, latest_for, release_order
from catalith.sources.catalog import Catalog


def platforms_summary(systems: Column) -> Column:
    """``Linux and macOS (Intel only)`` of an array of systems; "" when none of them is known."""
    has = lambda s: F.array_contains(systems, s)
    linux = F.when(has("aarch64-linux") | has("x86_64-linux"), F.lit("Linux"))
    arm, intel = has("aarch64-darwin"), has("x86_64-darwin")
    mac = F.when(arm & intel, "macOS").when(arm, "macOS (Apple Silicon only)").when(intel, "macOS (Intel only)")
    return F.concat_ws(" and ", linux, mac)


def outputs_summary(outputs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``(*by, outputs_summary)`` of rows ``(*by, system, name, is_default, *order)``: defaults first, then by name, each with where it is missing.

    Of several rows of an output on one system the last in ``order`` says whether it is a default; an output is one if it is on any system.
    "" when all are defaults; an output on no known kind of system reads "".
    """
    own = outputs.groupBy(*by, "name", "system").agg(F.max_by(F.coalesce("is_default", F.lit(False)), F.struct(*order)).alias("is_default"))
    os = F.get(F.split("system", "-"), F.lit(1))
    one = own.groupBy(*by, "name").agg(
        F.coalesce(F.bool_or(os == "linux"), F.lit(False)).alias("linux"),
        F.coalesce(F.bool_or(os == "darwin"), F.lit(False)).alias("darwin"),
        F.bool_or("is_default").alias("is_default"),
    )
    shown = F.when(F.col("darwin") & F.col("linux"), F.col("name")).when(F.col("darwin"), F.concat("name", F.lit(" (macOS only)"))).when(F.col("linux"), F.concat("name", F.lit(" (Linux only)"))).otherwise("")
    listed = one.groupBy(*by).agg(F.bool_and("is_default").alias("all"), F.array_sort(F.collect_set(F.struct((~F.col("is_default")).alias("later"), "name", shown.alias("shown")))).alias("a"))
    return listed.select(*by, F.when(F.col("all"), "").otherwise(F.array_join(F.transform("a", lambda x: x["shown"]), ", ")).alias("outputs_summary"))


def release_rows(rows: DataFrame) -> DataFrame:
    """``(package_id, name, version_id, version, last_updated, platforms, platforms_summary, prerelease, broken, insecure)`` of ``result_rows``.

    A platform is an architecture and operating system; of several rows the first by system and path stands for it, so
    unknown systems are one. ``last_updated`` is the newest of these; a release is broken or insecure if all of its rows are.
    """
    by = ["package_id", "name", "version_id", "version", "prerelease", "sort_key"]
    facts = rows.groupBy(*by).agg(
        F.bool_and(F.coalesce("broken", F.lit(False))).alias("broken"),
        F.bool_and(F.coalesce("insecure", F.lit(False))).alias("insecure"),
        platforms_summary(F.collect_set("system")).alias("platforms_summary"),
    )
    spot = arch_os(F.col("system"))
    kept = first_per_key(rows.withColumns({"arch": spot["arch"], "os": spot["os"]}), ["version_id", "arch", "os"], [F.asc("system"), F.asc("attr_path")])
    one = F.struct("system", "arch", "os", F.col("attr_path").alias("attribute_path"), "commit_hash", rfc3339(F.col("last_updated")).alias("date"), "broken", "insecure")
    kept = kept.groupBy("version_id").agg(F.max("last_updated").alias("last_updated"), F.array_sort(F.collect_list(one)).alias("platforms"))  # five at most
    out = facts.join(kept, "version_id")
    return out.select("package_id", "name", "version_id", "version", "sort_key", rfc3339(F.col("last_updated")).alias("last_updated"), "platforms", "platforms_summary", "prerelease", "broken", "insecure")


def release_neighbours(releases: DataFrame) -> DataFrame:
    """Adds the next ``newer`` and ``older`` version of the package in the order of releases."""
    w = Window.partitionBy("package_id").orderBy(*release_order())
    return releases.withColumns({"newer": F.lag("version").over(w), "older": F.lead("version").over(w)})


def package_document(rows: DataFrame) -> DataFrame:
    """``(document)``: the JSON of one name's releases, newest first, from ``result_rows`` of that name; the first row describes it, without rows there is none."""
    releases = release_rows(rows)
    ordered = releases.withColumn("_n", F.row_number().over(Window.orderBy(*release_order())))  # one name's releases
    one = F.struct("version", "last_updated", "platforms", "platforms_summary", "prerelease", "broken", "insecure")
    listed = ordered.agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", one.alias("r")))), lambda x: x["r"]).alias("releases"))
    first = rows.orderBy(*release_order(), "system", "attr_path", "variant_id").limit(1)
    head = first.select(F.struct("name", "summary", "description", F.col("homepage").alias("homepage_url"), "license").alias("h"))
    facts = rows.agg(F.array_sort(F.collect_set("attr_path")).alias("attribute_paths"))
    return head.join(F.broadcast(facts)).join(F.broadcast(listed)).select(F.to_json(F.struct("h.*", "attribute_paths", "releases")).alias("document"))


def resolve_document(rows: DataFrame) -> DataFrame:
    """``(document)``: the JSON of one version with one entry a system, the first by path."""
    first = first_per_key(rows, ["system"], [F.asc("attr_path")])
    entry = F.struct("system", F.struct("attr_path", F.col("commit_hash").alias("rev"), rfc3339(F.col("last_updated")).alias("last_updated")).alias("v"))
    made = first.agg(F.min("name").alias("name"), F.min("version").alias("version"), F.min("summary").alias("summary"), F.array_sort(F.collect_list(entry)).alias("a"))  # a row a system
    return made.where(F.size("a") > 0).select(F.to_json(F.struct("name", "version", "summary", F.map_from_entries("a").alias("systems"))).alias("document"))


def search_document(rows: DataFrame, phrase: str) -> DataFrame:
    """``(document)`` of the rows of a latest-only phrase search: at most fifty."""
    one = F.struct("ord", F.struct("name", "summary", rfc3339(F.col("last_updated")).alias("last_updated"), "version", F.col("attr_path").alias("attribute_path"), F.col("version_systems").alias("systems")).alias("r"))
    made = rows.agg(F.count(F.lit(1)).alias("total_results"), F.transform(F.array_sort(F.collect_list(one)), lambda x: x["r"]).alias("results"))
    return made.select(F.to_json(F.struct(F.lit(phrase).alias("query"), "total_results", "results")).alias("document"))


def legacy_versions(rows: DataFrame) -> DataFrame:
    """``(package_id, name, version_id, version, system, attr_paths, programs, last_updated, platforms)``: the older response's per-system entries.

    Rows of a version and system are one entry: the first by path gives its facts; platforms are those that are supported.
    """
    ordered = F.array_sort(F.collect_list(F.struct("attr_path", "program", "last_updated", "platforms")))
    made = rows.groupBy("package_id", "name", "version_id", "version", "system").agg(ordered.alias("a"))
    first = F.col("a")[0]
    return made.select(
        *["package_id", "name", "version_id", "version", "system"],
        F.array_join(F.transform("a", lambda x: x["attr_path"]), ",").alias("attr_paths"),
        F.array_join(F.transform(F.filter("a", lambda x: x["program"] != ""), lambda x: x["program"]), ",").alias("programs"),
        unix_seconds(first["last_updated"]).alias("last_updated"),
        F.array_join(F.filter(first["platforms"], supported), ",").alias("platforms"),
    )


def legacy_documents(rows: DataFrame) -> DataFrame:
    """``(package_id, version_id, document)``: the older response's entry of each version, with one for each of its systems.

    The first row by system and path gives the version's facts, the first of a system those of the system; fields that are null, "", false, 0 or empty are left out,
    the name never.
    """
    text = lambda k: F.when(F.col(k) != "", F.col(k)).alias(k)
    several = lambda x: F.when(F.size(x) > 0, x)
    updated = unix_seconds(F.col("last_updated"))
    shared = [text("commit_hash"), F.when(updated != 0, updated).alias("last_updated"), text("version"), several(F.filter("platforms", supported)).alias("platforms")]
    shared += map(text, ("summary", "description", "homepage", "license"))
    own = [*map(text, ("system", "store_hash", "store_name", "store_version", "meta_name")), several(F.col("meta_version")).alias("meta_version")]
    flags = [F.when(F.col(k), True).alias(k) for k in ("broken", "insecure")]
    one = F.struct("attr_path", "variant_id", "program", F.struct(*shared).alias("shared"), F.struct(*own).alias("own"), F.struct(*flags).alias("flags"))
    by = rows.groupBy("package_id", "version_id", "name", "system").agg(F.array_sort(F.collect_list(one)).alias("a"))
    programs = several(F.filter(F.col("a.program"), lambda x: x != ""))
    by = by.select("package_id", "version_id", "name", "system", F.col("a")[0].alias("first"), F.col("a.attr_path").alias("attr_paths"), programs.alias("programs"))
    entry = F.to_json(F.struct("first.shared.*", "first.own.*", "attr_paths", "programs", "first.flags.*"))
    listed = F.array_sort(F.collect_list(F.struct("system", F.col("first.shared").alias("shared"), entry.alias("entry"))))
    whole = by.groupBy("package_id", "version_id", "name").agg(listed.alias("s"))  # a row a system
    whole = whole.withColumn("shared", F.col("s")[0]["shared"]).withColumn("_head", F.to_json(F.struct("shared.*", "name")))
    systems = F.array_join(F.transform("s", lambda x: F.concat(quoted(x["system"]), F.lit(":"), x["entry"])), ",")
    return whole.select("package_id", "version_id", F.concat(F.expr("left(_head, length(_head) - 1)"), F.lit(',"systems":{'), systems, F.lit("}}")).alias("document"))


def status_document(c: Catalog, names: list[str]) -> DataFrame:
    """``(document)``: the catalog's counts, the ends of its timeline, each system's imports and what ``latest`` means for some names, in their order."""
    moment = lambda x: iso(F.col(x)).alias(x)
    counts = status.row_counts(c).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_name", "n_rows")))).alias("counts"))  # a row a table
    ends = status.commit_ends(c).select("place", F.struct("seq", "hash", moment("committed_at")).alias("c"))
    ends = ends.agg(*(F.max(F.when(F.col("place") == p, F.col("c"))).alias(f"{p}_commit") for p in ("oldest", "newest")))
    own = status.system_status(c)
    one = F.struct("system", F.col("imports").alias("commits"), F.struct(F.col("newest_seq").alias("seq"), F.col("commit_hash").alias("hash"), moment("committed_at")).alias("newest"), "nix_version")
    systems = own.agg(iso(F.max("last_import_at")).alias("last_import_at"), F.array_sort(F.collect_list(one)).alias("systems"))  # a row a system
    latest = F.struct("ord", F.struct(F.col("wanted").alias("name"), "version", "attr_path", F.coalesce(F.split("systems", ","), F.array().cast("array<string>")).alias("systems"), moment("last_updated")).alias("l"))
    asked = latest_for(c, names).agg(F.transform(F.array_sort(F.collect_list(latest)), lambda x: x["l"]).alias("latest_versions"))  # the caller's list
    parts = counts.join(F.broadcast(ends)).join(F.broadcast(systems)).join(F.broadcast(asked))  # one row each
    return parts.select(F.to_json(F.struct("counts", "oldest_commit", "newest_commit", "last_import_at", "systems", "latest_versions")).alias("document"))


def grouped_by_name(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``(run, name, num_versions)``: names of a listing in its order, a name that comes back being listed again."""
    runs = consecutive_groups(rows, [], order, "name")
    return runs.groupBy("run", "name").agg(F.count_distinct("version").alias("num_versions"))


def site_map(names: DataFrame, origin: str) -> DataFrame:
    """``(line)``: one location of the site map for each name."""
    url = escape_html(F.concat(F.lit(origin), package_path(F.col("name"))))
    return names.select("package_id", F.concat(F.lit("<url><loc>"), url, F.lit("</loc></url>")).alias("line"))


def site_map_index(names: DataFrame, origin: str, size: int = status.PAGE) -> DataFrame:
    """``(page, line)``: the pages that the site map of ``names`` has, one of no names too."""
    pages = names.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).alias("n")).select(F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("page"))
    return pages.select("page", F.concat(F.lit(f"<sitemap><loc>{origin}/sitemaps/"), F.col("page").cast("string"), F.lit(".xml</loc></sitemap>")).alias("line"))
