"""Queries over the catalog: lookups, choices of versions, search, history, merging and bookkeeping, each with its SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions import version as V
from catalith.functions.display import byte_size, copy_line, day_tag, describe_query, elapsed, escape_html, escape_like, etag, highlight, integer, omit_empty, package_path, query_path, rfc3339, short_system, time_tag, unix_seconds, url_segment
from catalith.functions.names import PHRASE_ALIASES
from catalith.functions.names import nfd as nfd_of
from catalith.functions.paths import arch_os, archive_key, canonical_name, listed_prefixes, parse_archive_name, split_reference, split_store_path, supported, top_level, xml_tag
from catalith.functions.trigram import similarity
from catalith.operators import history, importing, lookup, merge, phrase, render, seeding, status
from catalith.operators.decode import decode_latest, decode_packages
from catalith.operators.nested import shred
from catalith.plans.decoded_sql import TABLE, clean, decoded_sql, latest_sql, nfd
from catalith.plans.problems import P6_LEAVES
from catalith.sources.catalog import Catalog

BASE = """
WITH pk AS (SELECT DISTINCT id AS package_id, name, nfc_normalize(lower(name)) AS nk FROM packages),
ve AS (SELECT DISTINCT * EXCLUDE (id), id AS version_id FROM versions),
va AS (SELECT DISTINCT * EXCLUDE (id), id AS variant_id FROM variants),
ra AS (SELECT DISTINCT * FROM variant_ranges),
me AS (SELECT DISTINCT * EXCLUDE (id), id AS meta_id FROM meta),
co AS (SELECT DISTINCT * FROM commits),
im AS (SELECT DISTINCT * FROM commit_systems),
te AS (SELECT DISTINCT package_id, name, attr_path, CASE WHEN attr_path NOT LIKE '%.%' THEN attr_path END AS top
  FROM va JOIN ve USING (version_id) JOIN pk USING (package_id)),
seen AS (SELECT variant_id, max(coalesce(last_seq, 2147483647)) AS last_seen FROM ra WHERE NOT coalesce(seeded, false) GROUP BY 1)
"""
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Registers a function of a catalog under its own name, with the SQL that gives the same."""

    def registered(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Catalog(spark, folder))
        if sql:
            SQL[f.__name__] = (BASE if base else "") + sql
        return f

    return registered


def pipe(a: str):
    return F.array_join(F.transform(F.col(a), lambda x: F.coalesce(x, F.lit("~"))), "|")


# ---------------------------------------------------------------- versions


@query(r"""
SELECT version_id, array_to_string(list_transform(
  regexp_extract_all(regexp_replace(version, '^v([0-9])', '\1'), '([0-9]+|[^0-9._\-\x00-\x04]+)'),
  lambda c: CASE WHEN regexp_matches(c, '^[0-9]') THEN regexp_replace(c, '^0+(.)', '\1')
    WHEN lower(c) IN ('a','b','c','rc','alpha','beta','pre','preview') THEN lower(c) ELSE c END), '|') AS components FROM ve""")
def version_components(c: Catalog) -> DataFrame:
    return c.versions("version_id", "version").select("version_id", F.array_join(V.components(F.col("version")), "|").alias("components"))


@query("SELECT version_id, hex(sort_key) AS sort_key FROM ve WHERE sort_key IS NOT NULL")
def version_sort_keys(c: Catalog) -> DataFrame:
    """The engine's own key of each version whose record has one."""
    return c.versions("version_id", "version", "sort_key").where(F.col("sort_key").isNotNull()).select("version_id", F.hex(V.sort_key(F.col("version"))).alias("sort_key"))


@query("""
SELECT version_id, row_number() OVER (PARTITION BY package_id ORDER BY sort_key DESC NULLS LAST, version, version_id)::int AS place FROM ve""")
def version_order(c: Catalog) -> DataFrame:
    w = Window.partitionBy("package_id").orderBy(*lookup.release_order())
    return c.versions("version_id", "package_id", "sort_key", "version").select("version_id", F.row_number().over(w).alias("place"))


@query("""
SELECT a.version_id, CASE WHEN a.sort_key < b.sort_key THEN -1 WHEN a.sort_key > b.sort_key THEN 1 ELSE 0 END AS sign
FROM ve a JOIN ve b ON b.version_id = a.version_id + 1 WHERE a.sort_key IS NOT NULL AND b.sort_key IS NOT NULL""")
def version_comparison(c: Catalog) -> DataFrame:
    """Each version against the record with the next id."""
    v = c.versions("version_id", "version", "sort_key").where(F.col("sort_key").isNotNull()).select("version_id", "version")
    following = v.select((F.col("version_id") - 1).alias("version_id"), F.col("version").alias("other"))
    return v.join(following, "version_id").select("version_id", V.compare_versions(F.col("version"), F.col("other")).alias("sign"))


_ID = "(?:0|[1-9][0-9]*|[0-9]*[a-zA-Z-][0-9a-zA-Z-]*)"
_BUILD = r"(?:\+[0-9a-zA-Z-]+(?:\.[0-9a-zA-Z-]+)*)?"
_GO = rf"^v(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*))?)?(-{_ID}(?:\.{_ID})*)?{_BUILD}$"
_STRICT = rf"^v?(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-({_ID}(?:\.{_ID})*))?{_BUILD}$"
_PEP = r"^[\t\n\f\r ]*v?(?:[0-9]+!)?[0-9]+(?:\.[0-9]+)*([-_.]?(?:alpha|beta|preview|pre|rc|a|b|c)[-_.]?[0-9]*)(?:-[0-9]+|[-_.]?(?:post|rev|r)[-_.]?[0-9]*)?(?:[-_.]?dev[-_.]?[0-9]*)?(?:\+[a-z0-9]+(?:[-_.][a-z0-9]+)*)?[\t\n\f\r ]*$"


@query(f"""SELECT version_id, CASE WHEN regexp_matches(version, '{_GO}') THEN regexp_extract(version, '{_GO}', 1) <> ''
  ELSE regexp_matches(lower(version), '{_PEP}') OR regexp_matches(version, '(?:alpha|beta|pre|preview|rc)$') END AS prerelease FROM ve""")
def prerelease_flags(c: Catalog) -> DataFrame:
    return c.versions("version_id", "version", "prerelease").select("version_id", V.is_prerelease(F.col("version")).alias("prerelease"))


@query(f"""SELECT version_id, CASE WHEN ok THEN a END AS major, CASE WHEN ok THEN b END AS minor, CASE WHEN ok THEN c END AS patch, CASE WHEN ok THEN nullif(regexp_extract(version, '{_STRICT}', 4), '') END AS pre
FROM (SELECT *, coalesce(regexp_matches(version, '{_STRICT}') AND greatest(a, b, c) <= 9007199254740991 AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL, false) AS ok
FROM (SELECT version_id, version, try_cast(regexp_extract(version, '{_STRICT}', 1) AS bigint) AS a, try_cast(regexp_extract(version, '{_STRICT}', 2) AS bigint) AS b, try_cast(regexp_extract(version, '{_STRICT}', 3) AS bigint) AS c FROM ve))""")
def semver_parts(c: Catalog) -> DataFrame:
    s = V.semver(F.col("version"))
    return c.versions("version_id", "version").select("version_id", s["major"].alias("major"), s["minor"].alias("minor"), s["patch"].alias("patch"), F.nullif(s["pre"], F.lit("")).alias("pre"))


# ---------------------------------------------------------------- lookups

_HIT = """, hit AS (
  SELECT variant_id FROM va JOIN ve USING (version_id) JOIN pk USING (package_id) WHERE nk = nfc_normalize(lower('{0}'))
  UNION SELECT variant_id FROM va WHERE attr_path = '{0}')
"""
_WIDE = """va JOIN ve USING (version_id) JOIN pk USING (package_id) JOIN me USING (meta_id) JOIN co ON co.seq = va.commit_seq"""
_ROW = "variant_id, version_id, name, version, co.hash AS commit_hash, committed_at AS last_updated, attr_path, va.system, summary, license, broken, prerelease, array_to_string(platforms, '|') AS platforms"


def _row(df: DataFrame, *more: str) -> DataFrame:
    return df.withColumn("platforms", pipe("platforms")).select(*more, "variant_id", "version_id", "name", "version", "commit_hash", "last_updated", "attr_path", "system", "summary", "license", "broken", "prerelease", "platforms")


@query(_HIT.format("TarnWick") + "SELECT variant_id FROM hit")
def name_or_path_lookup(c: Catalog) -> DataFrame:
    return lookup.variants_of(c, "TarnWick").select("variant_id")


@query(_HIT.format("ocavelPackages.core") + f"SELECT {_ROW} FROM {_WIDE} WHERE variant_id IN (FROM hit)")
def versions_by_path(c: Catalog) -> DataFrame:
    return _row(lookup.versions_by_name(c, "ocavelPackages.core"))


@query(_HIT.format("brélune") + f"SELECT {_ROW} FROM {_WIDE} WHERE variant_id IN (FROM hit) AND NOT prerelease AND va.system = 'x86_64-linux'")
def versions_by_name(c: Catalog) -> DataFrame:
    return _row(lookup.versions_by_name(c, "BRÉLUNE", "x86_64-linux", no_prerelease=True))


@query(f"SELECT {_ROW} FROM {_WIDE}")
def wide_rows(c: Catalog) -> DataFrame:
    return _row(lookup.result_rows(c, c.shown_variants()))


@query("SELECT variant_id, last_seen FROM seen")
def variant_last_seen(c: Catalog) -> DataFrame:
    return lookup.last_seen(c.ranges("variant_id", "last_seq", "seeded"))


_STANDING = """, standing AS (
  SELECT version_id, bool_or(NOT coalesce(broken, false)) AS working, max(coalesce(last_seen, 0)) AS last_seen
  FROM va LEFT JOIN seen USING (variant_id) {where} GROUP BY 1)
"""


def _latest(by: str, where: str = "", first: str = "prerelease, ", keep: str = "") -> str:
    return _STANDING.format(where=where) + f""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {first} working DESC, standing.last_seen DESC, sort_key DESC NULLS LAST, version, version_id) AS place
  FROM standing JOIN ve USING (version_id) JOIN pk USING (package_id) {keep})
"""


@query(_latest("package_id") + "SELECT package_id, version_id, version, prerelease FROM ranked WHERE place = 1")
def latest_per_package(c: Catalog) -> DataFrame:
    """What ``latest`` means for every package at once."""
    return lookup.latest_versions(c)


@query(_latest("nk") + "SELECT version_id, version, prerelease FROM ranked WHERE place = 1")
def latest_per_name(c: Catalog) -> DataFrame:
    return lookup.latest_versions(c, "name_key").select("version_id", "version", "prerelease")


@query(_latest("package_id", "WHERE system = 'aarch64-darwin'", "", "WHERE NOT prerelease") + "SELECT package_id, version_id, version, prerelease FROM ranked WHERE place = 1")
def latest_on_system(c: Catalog) -> DataFrame:
    return lookup.latest_versions(c, system="aarch64-darwin", prereleases="never")


WANTED = ["tarnwick", "Pyrennet", "no-such-package", "ocavelPackages.core", "BRÉLUNE", "vessimur"]


@query(f""", wanted AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{n}')" for k, n in enumerate(WANTED, 1))}) w(ord, wanted)),
hits AS (
  SELECT ord, variant_id, version_id FROM wanted JOIN pk ON nk = nfc_normalize(lower(wanted)) JOIN ve USING (package_id) JOIN va USING (version_id)
  UNION SELECT ord, variant_id, version_id FROM wanted JOIN va ON attr_path = wanted),
best AS (
  SELECT ord, version_id, version FROM (
    SELECT ord, version_id, version, row_number() OVER (PARTITION BY ord ORDER BY prerelease,
      EXISTS (SELECT 1 FROM va b WHERE b.version_id = h.version_id AND NOT coalesce(b.broken, false)) DESC, coalesce(last_seen, 0) DESC, sort_key DESC NULLS LAST, version, version_id) AS n
    FROM hits h LEFT JOIN seen USING (variant_id) JOIN ve USING (version_id)) WHERE n = 1),
facts AS (
  SELECT ord, best.version, string_agg(DISTINCT va.system, ',' ORDER BY va.system) AS systems, min(attr_path) AS attr_path, max(committed_at) AS last_updated
  FROM best JOIN va USING (version_id) JOIN co ON co.seq = va.commit_seq GROUP BY ALL)
SELECT ord, wanted, version, systems, attr_path, last_updated FROM wanted LEFT JOIN facts USING (ord)""")
def latest_for_list(c: Catalog) -> DataFrame:
    return lookup.latest_for(c, WANTED)


REQUESTS = [("tarnwick", "^1.100"), ("tarnwick", "~2.1"), ("pyrennet", ">=1.2 <2"), ("Pyrennet", "3"), ("vessimur", "1.16"), ("halquist", "1.163.3+build7"), ("ocavelPackages.core", "^2.0.0"), ("tarnwick", "999"), ("halquist", "1.160.1-rc2"), ("brélune", "<=1.200")]
# Bounds of the same requests as (ord, low, low included, high, high included, prereleases meant); none for what is no range.
_BOUNDS = """(1, [1,100,0], true, [2,0,0], false), (2, [2,1,0], true, [2,2,0], false), (3, [1,2,0], true, [2,0,0], false), (4, [3,0,0], true, [4,0,0], false),
  (5, [1,16,0], true, [1,17,0], false), (7, [2,0,0], true, [3,0,0], false), (8, [999,0,0], true, [1000,0,0], false), (10, [0,0,0], true, [1,200,0], true)"""


@query(f""", wanted AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{n}', '{t}')" for k, (n, t) in enumerate(REQUESTS, 1))}) w(ord, wanted, "constraint")),
bounds AS (SELECT * FROM (VALUES {_BOUNDS}) b(ord, low, low_in, high, high_in)),
candidates AS (
  SELECT ord, version_id FROM wanted JOIN pk ON nk = nfc_normalize(lower(wanted)) JOIN ve USING (package_id) WHERE version_id IN (SELECT version_id FROM va)
  UNION SELECT ord, version_id FROM wanted JOIN va ON attr_path = wanted),
judged AS (
  SELECT ord, version_id, version, sort_key, [semver_major, semver_minor, semver_patch] AS n,
    coalesce(semver_major IS NOT NULL AND coalesce(semver_pre, '') = '' AND (n > low OR low_in AND n = low) AND (n < high OR high_in AND n = high), false)
      OR ord = 9 AND coalesce(n = [1,160,1] AND semver_pre = 'rc2', false) AS fits,
    version = "constraint" OR starts_with(version, "constraint" || '.') OR starts_with(version, "constraint" || '-') AS near
  FROM candidates JOIN wanted USING (ord) JOIN ve USING (version_id) LEFT JOIN bounds USING (ord)),
best AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY fits DESC, sort_key DESC NULLS LAST, version, version_id) AS place FROM judged WHERE fits OR near)
SELECT ord, wanted, "constraint", version_id, version FROM wanted LEFT JOIN (FROM best WHERE place = 1) USING (ord)""")
def constrained_versions(c: Catalog) -> DataFrame:
    return lookup.constrained_versions(c, REQUESTS)


@query(_HIT.format("tarnwick") + _STANDING.format(where="") + f""", best AS (
  SELECT version_id FROM va JOIN hit USING (variant_id) LEFT JOIN seen USING (variant_id) JOIN ve USING (version_id) JOIN standing USING (version_id)
  WHERE NOT prerelease ORDER BY working DESC, coalesce(seen.last_seen, 0) DESC, sort_key DESC NULLS LAST, version, version_id LIMIT 1)
SELECT {_ROW} FROM {_WIDE} WHERE version_id IN (FROM best)""")
def resolve_latest(c: Catalog) -> DataFrame:
    return _row(lookup.resolve(c, "tarnwick", "latest"))


@query("""SELECT package_id, place, version, systems FROM (
  SELECT package_id, version, version_id, row_number() OVER (PARTITION BY package_id ORDER BY sort_key DESC NULLS LAST, version, version_id)::int AS place
  FROM ve WHERE version_id IN (SELECT version_id FROM va)) r
JOIN (SELECT version_id, string_agg(DISTINCT system, ',' ORDER BY system) AS systems FROM va GROUP BY 1) USING (version_id) WHERE place <= 3""".join([", one AS (SELECT 1) ", ""]))
def newest_releases(c: Catalog) -> DataFrame:
    return lookup.newest_releases(c, 3)


@query("SELECT version_id, string_agg(DISTINCT system, ',' ORDER BY system) AS systems FROM va GROUP BY 1")
def version_systems(c: Catalog) -> DataFrame:
    return c.variants("version_id", "system").groupBy("version_id").agg(F.array_join(F.array_sort(F.collect_set("system")), ",").alias("systems"))


@query("""SELECT variant_id, version_id FROM (
  SELECT variant_id, version_id, row_number() OVER (PARTITION BY version_id, system ORDER BY attr_path, variant_id) AS n FROM va) WHERE n = 1""")
def first_path_per_system(c: Catalog) -> DataFrame:
    return lookup.first_per_key(c.variants("variant_id", "version_id", "system", "attr_path"), ["version_id", "system"], [F.asc("attr_path"), F.asc("variant_id")]).select("variant_id", "version_id")


# ---------------------------------------------------------------- search

_TRIGRAMS = """
list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


def _similar(a: str, b: str) -> str:
    return f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END)"


@query(f", g AS (SELECT DISTINCT name, {_TRIGRAMS.format('name')} AS a, {_TRIGRAMS.format(chr(39) + 'ocavel core' + chr(39))} AS b FROM pk) SELECT name, round({_similar('a', 'b')}, 6) AS similarity FROM g")
def trigram_similarity(c: Catalog) -> DataFrame:
    return c.packages("name").distinct().select("name", F.round(similarity(F.col("name"), F.lit("ocavel core")), 6).alias("similarity"))


def _ranked(text: str, hits: int = 50, alias: str = "false") -> str:
    low = text.lower()
    return f""", g AS (SELECT *, {_TRIGRAMS.format('name')} AS a, {_TRIGRAMS.format('attr_path')} AS p, {_TRIGRAMS.format(chr(39) + text + chr(39))} AS b FROM te),
s AS (SELECT *, {_similar('a', 'b')} AS sa, {_similar('p', 'b')} AS sp FROM g),
r AS (SELECT package_id, name, CASE WHEN {alias} THEN 2000 WHEN lower(name) = '{low}' THEN 1000 WHEN lower(attr_path) = '{low}' THEN 900
    WHEN starts_with(lower(name), '{low}') THEN 800 WHEN starts_with(lower(attr_path), '{low}') THEN 700 ELSE 0 END
    + 100 * greatest(sa, sp) + CASE WHEN top IS NULL THEN 0 ELSE 25 END AS rank
  FROM s WHERE {alias} OR starts_with(lower(name), '{low}') OR starts_with(lower(attr_path), '{low}') OR sa >= 0.3 OR sp >= 0.3),
hits AS (SELECT row_number() OVER (ORDER BY rank DESC, name, package_id)::int AS ord, * FROM (SELECT package_id, name, max(rank) AS rank FROM r GROUP BY ALL) QUALIFY ord <= {hits})
"""


@query(_ranked("ocavel") + "SELECT ord, package_id, name, round(rank, 6) AS rank FROM hits")
def phrase_ranking(c: Catalog) -> DataFrame:
    return phrase.rank_phrase(c, "ocavel").withColumn("rank", F.round("rank", 6))


@query(_ranked("pyrennet", 5) + "SELECT ord, package_id, name, round(rank, 6) AS rank FROM hits")
def phrase_ranking_capped(c: Catalog) -> DataFrame:
    return phrase.rank_phrase(c, "pyrennet", hits=5).withColumn("rank", F.round("rank", 6))


@query(_ranked("oldbird", alias="lower(name) IN ('vessimur') OR lower(attr_path) IN ('vessimur')") + "SELECT ord, package_id, name, round(rank, 6) AS rank FROM hits")
def phrase_ranking_alias(c: Catalog) -> DataFrame:
    return phrase.rank_phrase(c, "oldbird", aliases={"oldbird": ["vessimur"]}).withColumn("rank", F.round("rank", 6))


_KNOWN = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(a) for a in v)}]" for k, v in PHRASE_ALIASES.items()) + "}"


@query(f""", asked AS (SELECT DISTINCT name AS phrase, lower(name) AS low, {_TRIGRAMS.format('name')} AS b, CASE WHEN regexp_matches(name, '[\\p{{L}}\\p{{N}}]') THEN coalesce({_KNOWN}[lower(name)], []) ELSE [] END AS known
  FROM pk WHERE package_id % 20 = 0),
g AS (SELECT *, {_TRIGRAMS.format('name')} AS a, {_TRIGRAMS.format('attr_path')} AS p FROM te),
s AS (SELECT *, {_similar('a', 'b')} AS sa, {_similar('p', 'b')} AS sp, list_contains(known, lower(name)) OR list_contains(known, lower(attr_path)) AS alias FROM g, asked),
r AS (SELECT phrase, package_id, name, CASE WHEN alias THEN 2000 WHEN lower(name) = low THEN 1000 WHEN lower(attr_path) = low THEN 900 WHEN starts_with(lower(name), low) THEN 800 WHEN starts_with(lower(attr_path), low) THEN 700 ELSE 0 END
    + 100 * greatest(sa, sp) + CASE WHEN top IS NULL THEN 0 ELSE 25 END AS rank
  FROM s WHERE alias OR starts_with(lower(name), low) OR starts_with(lower(attr_path), low) OR sa >= 0.3 OR sp >= 0.3),
best AS (SELECT phrase, package_id, name, max(rank) AS rank FROM r GROUP BY ALL)
SELECT phrase, row_number() OVER (PARTITION BY phrase ORDER BY rank DESC, name, package_id)::int AS ord, package_id, name, round(rank, 6) AS rank FROM best QUALIFY ord <= 50""")
def phrase_rankings(c: Catalog) -> DataFrame:
    """The ranking of many phrases at once: the name of each package whose id is divisible by 20."""
    asked = c.packages("package_id", "name").where(F.col("package_id") % 20 == 0)
    return phrase.rank_phrases(c, asked.select(F.col("name").alias("phrase"))).withColumn("rank", F.round("rank", 6))


@query(_ranked("ocavel") + _latest("package_id") + f""", chosen AS (SELECT ord, version_id FROM ranked JOIN hits USING (package_id) WHERE place = 1)
SELECT ord, {_ROW} FROM {_WIDE} JOIN chosen USING (version_id) QUALIFY row_number() OVER (PARTITION BY ord ORDER BY va.system, attr_path) = 1""")
def phrase_search_latest(c: Catalog) -> DataFrame:
    return _row(phrase.search_phrase(c, "ocavel"), "ord")


@query(_ranked("ocavel-k") + f""", rows AS (
SELECT ord, sort_key, {_ROW} FROM {_WIDE} JOIN (SELECT ord, package_id FROM hits) h USING (package_id)
QUALIFY row_number() OVER (PARTITION BY ord, sort_key, version ORDER BY va.system, attr_path) = 1)
SELECT * EXCLUDE (sort_key) FROM (FROM rows ORDER BY ord, sort_key DESC NULLS LAST, version, version_id, system, attr_path LIMIT 1000)""")
def phrase_search_versions(c: Catalog) -> DataFrame:
    return _row(phrase.search_phrase(c, "ocavel-k", latest_only=False), "ord")


@query("SELECT package_id, name, attr_path, top AS top_level_attr FROM te")
def search_terms(c: Catalog) -> DataFrame:
    return c.search_terms


# ---------------------------------------------------------------- history

_EVALUATED = """, rows_ AS (SELECT system, commit_seq, name_key, version, attr_path, max(lower(content_hash)) AS content_hash
  FROM stage_variants WHERE store_hash <> '' GROUP BY ALL),
evals AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY commit_seq) AS n FROM (SELECT DISTINCT system, commit_seq FROM rows_))
"""


@query(_EVALUATED + """, keyed AS (SELECT *, n - row_number() OVER (PARTITION BY system, name_key, version, attr_path ORDER BY commit_seq) AS run FROM rows_ JOIN evals USING (system, commit_seq)),
runs AS (SELECT system, name_key, version, attr_path, min(commit_seq) AS first_seq, max(commit_seq) AS last_seq FROM keyed GROUP BY system, name_key, version, attr_path, run)
SELECT *, (SELECT min(commit_seq) FROM im WHERE im.system = runs.system AND im.commit_seq > runs.last_seq) AS next_seq FROM runs""")
def presence_runs(c: Catalog) -> DataFrame:
    return history.presence_runs(c, history.evaluated_rows(c))


@query(_EVALUATED + """, marked AS (SELECT *, CASE WHEN content_hash IS DISTINCT FROM lag(content_hash) OVER w THEN 1 ELSE 0 END AS new FROM rows_
  WINDOW w AS (PARTITION BY system, name_key, version, attr_path ORDER BY commit_seq)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY system, name_key, version, attr_path ORDER BY commit_seq ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT system, name_key, version, attr_path, max(content_hash) AS content_hash, min(commit_seq) AS content_seq FROM runs
GROUP BY system, name_key, version, attr_path, run QUALIFY row_number() OVER (PARTITION BY system, name_key, version, attr_path ORDER BY run DESC) = 1""")
def content_first_seen(c: Catalog) -> DataFrame:
    return history.content_first_seen(history.evaluated_rows(c))


@query(""", first AS (SELECT * FROM va QUALIFY row_number() OVER (PARTITION BY version_id, system ORDER BY attr_path, variant_id) = 1),
spans AS (SELECT DISTINCT version_id, system, first_seq AS lo, coalesce(last_seq, (SELECT max(commit_seq) FROM im WHERE im.system = first.system)) AS hi
  FROM ra JOIN first USING (variant_id) WHERE NOT coalesce(seeded, false)),
good AS (SELECT * FROM spans WHERE lo <= hi),
live AS (SELECT version_id, count(DISTINCT system) AS n FROM good GROUP BY 1),
met AS (SELECT a.version_id, a.hi, count(DISTINCT b.system) AS n FROM (SELECT DISTINCT version_id, hi FROM good) a JOIN good b ON a.version_id = b.version_id AND b.lo <= a.hi AND a.hi <= b.hi GROUP BY ALL),
best AS (SELECT version_id, live.n AS systems, max(hi) AS commit_seq FROM met JOIN live USING (version_id) WHERE met.n = live.n AND live.n >= 2 GROUP BY ALL)
SELECT version_id, systems, commit_seq, co.hash AS commit_hash, committed_at FROM best JOIN co ON co.seq = best.commit_seq""")
def common_commits(c: Catalog) -> DataFrame:
    return history.common_commits(c)


# ---------------------------------------------------------------- merging

_EVALS = """, heads AS (SELECT system, max(commit_seq) AS commit_seq FROM stage_keys WHERE (commit_seq, system) IN (SELECT (commit_seq, system) FROM im) GROUP BY 1),
ev AS (SELECT system, commit_seq, name_key, version, attr_path, min(name) AS name, min(lower(meta_hash)) AS meta_hash, min(lower(content_hash)) AS content_hash
  FROM stage_keys JOIN heads USING (system, commit_seq) GROUP BY ALL),
evk AS (SELECT *, nfc_normalize(name_key) AS nk FROM ev),
prev AS (SELECT system, commit_seq, (SELECT max(im.commit_seq) FROM im WHERE im.system = heads.system AND im.commit_seq < heads.commit_seq) AS previous_seq FROM heads),
listed AS (SELECT e.*, ve.version_id, va.variant_id, lower(va.content_hash) AS old_hash FROM evk e JOIN pk USING (nk) JOIN ve ON ve.package_id = pk.package_id AND ve.version = e.version
  LEFT JOIN va ON va.version_id = ve.version_id AND va.system = e.system AND va.attr_path = e.attr_path),
closing AS (SELECT variant_id, first_seq, previous_seq AS last_seq FROM ra JOIN va USING (variant_id) JOIN ve USING (version_id) JOIN pk USING (package_id) JOIN prev USING (system)
  WHERE ra.last_seq IS NULL AND previous_seq IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM evk e WHERE e.system = va.system AND e.nk = pk.nk AND e.version = ve.version AND e.attr_path = va.attr_path)),
opening AS (SELECT DISTINCT variant_id, commit_seq AS first_seq FROM listed WHERE variant_id IS NOT NULL
  AND variant_id NOT IN (SELECT variant_id FROM ra WHERE last_seq IS NULL) AND (variant_id, commit_seq) NOT IN (SELECT (variant_id, first_seq) FROM ra))
"""


@query(_EVALS + "SELECT system, commit_seq, previous_seq FROM prev")
def previous_imports(c: Catalog) -> DataFrame:
    return merge.previous_imports(c, merge.newest_evaluations(c))


@query(_EVALS + "SELECT min(name) AS name FROM evk WHERE nk NOT IN (SELECT nk FROM pk) GROUP BY nk")
def missing_packages(c: Catalog) -> DataFrame:
    return merge.missing_packages(c, merge.newest_evaluations(c)).select("name")


@query(_EVALS + "SELECT DISTINCT package_id, evk.version FROM evk JOIN pk USING (nk) WHERE (package_id, evk.version) NOT IN (SELECT (package_id, version) FROM ve)")
def missing_versions(c: Catalog) -> DataFrame:
    return merge.missing_versions(c, merge.newest_evaluations(c)).select("package_id", "version")


@query(_EVALS + "SELECT DISTINCT meta_hash FROM ev WHERE meta_hash IS NOT NULL AND meta_hash NOT IN (SELECT lower(hash) FROM me)")
def missing_meta(c: Catalog) -> DataFrame:
    return merge.missing_meta(c, merge.newest_evaluations(c))


@query(_EVALS + "SELECT system, name_key, version, attr_path, variant_id FROM listed WHERE variant_id IS NULL OR old_hash <> content_hash")
def changed_variants(c: Catalog) -> DataFrame:
    return merge.changed_variants(c, merge.newest_evaluations(c))


@query(_EVALS + """SELECT system, scanned, coalesce(changed, 0) AS changed, previous_seq IS NOT NULL AND coalesce(changed, 0) / scanned > 0.2 AS warn
FROM (SELECT system, count(*) AS scanned FROM ev GROUP BY 1) JOIN prev USING (system)
LEFT JOIN (SELECT system, count(*) AS changed FROM listed WHERE variant_id IS NULL OR old_hash <> content_hash GROUP BY 1) USING (system)""")
def change_ratios(c: Catalog) -> DataFrame:
    evals = merge.newest_evaluations(c)
    return merge.change_ratios(merge.changed_variants(c, evals), evals, merge.previous_imports(c, evals))


@query(_EVALS + "FROM closing")
def close_ranges(c: Catalog) -> DataFrame:
    return merge.ranges_to_close(c, merge.newest_evaluations(c))


@query(_EVALS + "FROM opening")
def open_ranges(c: Catalog) -> DataFrame:
    return merge.ranges_to_open(c, merge.newest_evaluations(c))


@query(_EVALS + """SELECT variant_id, first_seq, coalesce(ra.last_seq, closing.last_seq) AS last_seq, seeded, backfill_last_seq FROM ra LEFT JOIN closing USING (variant_id, first_seq)
UNION ALL SELECT variant_id, first_seq, NULL, false, NULL FROM opening""")
def merged_ranges(c: Catalog) -> DataFrame:
    return merge.merged_ranges(c, merge.newest_evaluations(c))


def _arrivals(c: Catalog) -> DataFrame:
    rows = merge.listed_variants(c, merge.newest_evaluations(c), "left")
    return rows.where(F.col("variant_id").isNull() | (F.col("old_hash") != F.col("content_hash"))).select("version_id", "system", "attr_path", "commit_seq", "content_hash")


_ARRIVALS = _EVALS + """, arrivals AS (SELECT version_id, system, attr_path, commit_seq, content_hash FROM listed WHERE variant_id IS NULL OR old_hash <> content_hash),
olds AS (SELECT version_id, system, attr_path, commit_seq AS seq, lower(content_hash) AS hash FROM va)
"""


@query(_ARRIVALS + """SELECT version_id, system, attr_path, coalesce(a.commit_seq, o.seq) AS commit_seq, CASE WHEN a.commit_seq IS NULL THEN o.hash ELSE a.content_hash END AS content_hash
FROM olds o FULL JOIN arrivals a USING (version_id, system, attr_path)""")
def upserted_variants(c: Catalog) -> DataFrame:
    return merge.upserted_variants(c, _arrivals(c))


@query(_EVALS + """, arrivals AS (SELECT version_id, system, attr_path, commit_seq - 100 AS commit_seq, content_hash FROM listed),
olds AS (SELECT version_id, system, attr_path, commit_seq AS seq, lower(content_hash) AS hash FROM va),
both_ AS (SELECT *, a.commit_seq IS NOT NULL AND (o.seq IS NULL OR o.seq < a.commit_seq OR coalesce(o.hash = a.content_hash AND a.commit_seq < o.seq, false)) AS takes
  FROM olds o FULL JOIN arrivals a USING (version_id, system, attr_path))
SELECT version_id, system, attr_path, CASE WHEN takes THEN commit_seq ELSE seq END AS commit_seq, CASE WHEN takes THEN content_hash ELSE hash END AS content_hash FROM both_""")
def upserted_late(c: Catalog) -> DataFrame:
    """Late history: evaluations as if a hundred commits earlier, under the conditional rule."""
    rows = merge.listed_variants(c, merge.newest_evaluations(c), "left").withColumn("commit_seq", F.col("commit_seq") - 100)
    return merge.upserted_variants(c, rows, conditional=True)


@query(_EVALS + """SELECT DISTINCT package_id, pk.name, attr_path, CASE WHEN attr_path NOT LIKE '%.%' THEN attr_path END AS top_level_attr FROM evk JOIN pk USING (nk)
WHERE (pk.name, attr_path) NOT IN (SELECT (name, attr_path) FROM te)""")
def new_search_terms(c: Catalog) -> DataFrame:
    return merge.search_terms_of(c, merge.newest_evaluations(c))


_STAGED = """, st AS (SELECT DISTINCT variant_id, s.system, s.first_seq, s.last_seq, s.next_seq FROM stage_backfill_ranges s JOIN pk ON pk.nk = nfc_normalize(s.name_key)
  JOIN ve ON ve.package_id = pk.package_id AND ve.version = s.version JOIN va ON va.version_id = ve.version_id AND va.system = s.system AND va.attr_path = s.attr_path),
covered AS (SELECT DISTINCT ra.variant_id, ra.first_seq FROM ra JOIN st ON st.variant_id = ra.variant_id AND st.first_seq <= ra.first_seq AND ra.first_seq <= st.last_seq WHERE seeded)
"""


@query(_STAGED + "SELECT variant_id, system, first_seq, last_seq, next_seq FROM st")
def staged_ranges(c: Catalog) -> DataFrame:
    return merge.staged_ranges(c)


@query(_STAGED + "FROM covered")
def covered_points(c: Catalog) -> DataFrame:
    return merge.covered_points(c, merge.staged_ranges(c))


@query(_STAGED + """SELECT DISTINCT st.variant_id, st.first_seq, st.last_seq, r.first_seq AS live_first, r.last_seq AS live_last,
  CASE WHEN r.backfill_last_seq IS NULL THEN 'forward import' ELSE 'earlier backfill' END AS written_by
FROM st JOIN ra r ON r.variant_id = st.variant_id AND NOT coalesce(r.seeded, false)
WHERE NOT (r.first_seq = st.first_seq AND coalesce(r.backfill_last_seq = st.last_seq, false)) AND r.first_seq <= st.last_seq AND coalesce(r.last_seq, 2147483647) >= st.first_seq""")
def overlapping_ranges(c: Catalog) -> DataFrame:
    return merge.overlapping_ranges(c, merge.staged_ranges(c)).distinct()


@query(_STAGED + """, windows AS (SELECT system, min(first_seq) AS a, max(last_seq) AS b FROM st GROUP BY 1)
SELECT variant_id, ra.first_seq, coalesce(ra.last_seq = backfill_last_seq, false) AS whole FROM ra JOIN va USING (variant_id) JOIN windows USING (system)
WHERE backfill_last_seq IS NOT NULL AND NOT coalesce(seeded, false) AND a <= ra.first_seq AND backfill_last_seq <= b AND variant_id IN (SELECT variant_id FROM st)
  AND NOT EXISTS (SELECT 1 FROM st WHERE st.variant_id = ra.variant_id AND st.first_seq = ra.first_seq AND st.last_seq = ra.backfill_last_seq)""")
def stale_parts(c: Catalog) -> DataFrame:
    return merge.stale_parts(c, merge.staged_ranges(c))


@query(_STAGED + """, runs AS (SELECT variant_id, next_seq, min({'f': first_seq, 'l': last_seq}) AS s FROM st WHERE next_seq IS NOT NULL GROUP BY ALL),
windows AS (SELECT system, min(first_seq) AS a, max(last_seq) AS b FROM st GROUP BY 1),
stale AS (
  SELECT variant_id, ra.first_seq, coalesce(ra.last_seq = backfill_last_seq, false) AS whole, (SELECT min(commit_seq) FROM im WHERE im.system = va.system AND im.commit_seq > backfill_last_seq) AS start
  FROM ra JOIN va USING (variant_id) JOIN windows USING (system)
  WHERE backfill_last_seq IS NOT NULL AND NOT coalesce(seeded, false) AND a <= ra.first_seq AND backfill_last_seq <= b AND variant_id IN (SELECT variant_id FROM st)
    AND NOT EXISTS (SELECT 1 FROM st WHERE st.variant_id = ra.variant_id AND st.first_seq = ra.first_seq AND st.last_seq = ra.backfill_last_seq)),
back AS (
  SELECT variant_id, CASE WHEN whole IS NOT NULL AND (last_seq IS NULL OR last_seq > backfill_last_seq) THEN start ELSE first_seq END AS first_seq, last_seq, seeded,
    CASE WHEN whole IS NOT NULL AND (last_seq IS NULL OR last_seq > backfill_last_seq) THEN NULL ELSE backfill_last_seq END AS backfill_last_seq
  FROM ra LEFT JOIN stale USING (variant_id, first_seq) WHERE NOT coalesce(whole, false)),
kept AS (SELECT ra.*, s.f AS f, s.l AS l, s IS NOT NULL AND NOT coalesce(seeded, false) AS extends FROM back ra LEFT JOIN runs ON runs.variant_id = ra.variant_id AND runs.next_seq = ra.first_seq
  WHERE NOT (coalesce(seeded, false) AND (ra.variant_id, ra.first_seq) IN (SELECT (variant_id, first_seq) FROM covered))),
moved AS (SELECT variant_id, CASE WHEN extends THEN f ELSE first_seq END AS first_seq, last_seq, seeded, CASE WHEN extends THEN coalesce(backfill_last_seq, l) ELSE backfill_last_seq END AS backfill_last_seq FROM kept)
FROM moved UNION ALL
SELECT variant_id, first_seq, max(last_seq), false, max(last_seq) FROM st WHERE (variant_id, first_seq) NOT IN (SELECT (variant_id, first_seq) FROM moved) GROUP BY ALL""")
def backfilled_ranges(c: Catalog) -> DataFrame:
    return merge.backfilled_ranges(c, merge.staged_ranges(c))


def _arrived(c: Catalog) -> dict[str, DataFrame]:
    """The tables after the newest evaluation of each system is imported, which counts as not imported yet."""
    evals = merge.newest_evaluations(c)
    heads = evals.groupBy("system").agg(F.min("commit_seq").alias("_head"))
    imports = c.imports()
    before = Catalog(c.spark, c.base)
    before._raw["commit_systems"] = imports.join(F.broadcast(heads), "system", "left").where(F.col("_head").isNull() | (F.col("commit_seq") < F.col("_head"))).select(*imports.columns)
    return importing.imported(before, evals, c.raw("stage_variants"), datetime.datetime(2026, 6, 1))


_HELD = _EVALS.rstrip() + """,
held AS (SELECT system, commit_seq, name_key, version, attr_path, min(store_hash) AS store_hash, min(store_name) AS store_name, min(broken) AS broken, min(insecure) AS insecure, min(lower(meta_hash)) AS mh, min(lower(content_hash)) AS hh
  FROM stage_variants WHERE store_hash <> '' GROUP BY ALL),
came AS (SELECT l.version_id, l.system, l.attr_path, l.commit_seq, h.store_hash, h.store_name, h.broken, h.insecure, coalesce(l.content_hash, h.hh) AS content_hash, me.meta_id
  FROM listed l JOIN held h USING (system, commit_seq, name_key, version, attr_path) LEFT JOIN me ON lower(me.hash) = h.mh
  QUALIFY row_number() OVER (PARTITION BY l.version_id, l.system, l.attr_path ORDER BY l.commit_seq DESC, coalesce(l.content_hash, h.hh) DESC) = 1),
after_ AS (
  SELECT v.variant_id, v.version_id, v.system, v.attr_path, CASE WHEN t THEN c.meta_id ELSE v.meta_id END AS meta_id, CASE WHEN t THEN c.commit_seq ELSE v.commit_seq END AS commit_seq, CASE WHEN t THEN c.store_hash ELSE v.store_hash END AS store_hash,
    CASE WHEN t THEN c.store_name ELSE v.store_name END AS store_name, CASE WHEN t THEN c.broken ELSE v.broken END AS broken, CASE WHEN t THEN c.insecure ELSE v.insecure END AS insecure, CASE WHEN t THEN c.content_hash ELSE v.content_hash END AS content_hash
  FROM (SELECT v.*, c.version_id IS NOT NULL AND lower(v.content_hash) IS DISTINCT FROM lower(c.content_hash) AS t FROM va v LEFT JOIN came c USING (version_id, system, attr_path)) v LEFT JOIN came c USING (version_id, system, attr_path)
  UNION ALL SELECT (SELECT max(variant_id) FROM va) + row_number() OVER (ORDER BY version_id, system, attr_path), version_id, system, attr_path, meta_id, commit_seq, store_hash, store_name, broken, insecure, content_hash
  FROM came WHERE (version_id, system, attr_path) NOT IN (SELECT (version_id, system, attr_path) FROM va))
"""
_VARIANT_COLUMNS = ["variant_id", "version_id", "system", "attr_path", "meta_id", "commit_seq", "store_hash", "store_name", "broken", "insecure", "content_hash"]


@query(_HELD + f"SELECT {', '.join(_VARIANT_COLUMNS)} FROM after_")
def imported_variants(c: Catalog) -> DataFrame:
    return _arrived(c)["variants"].withColumnRenamed("id", "variant_id").select(*_VARIANT_COLUMNS)


@query(_HELD + """SELECT variant_id, first_seq, coalesce(ra.last_seq, closing.last_seq) AS last_seq, seeded, backfill_last_seq FROM ra LEFT JOIN closing USING (variant_id, first_seq)
UNION ALL SELECT variant_id, first_seq, NULL, false, NULL FROM opening
UNION ALL SELECT variant_id, commit_seq, NULL, false, NULL FROM after_ WHERE variant_id > (SELECT max(variant_id) FROM va)""")
def imported_ranges(c: Catalog) -> DataFrame:
    return _arrived(c)["variant_ranges"]


@query(_EVALS + """SELECT package_id, name, attr_path, top AS top_level_attr FROM te
UNION SELECT package_id, pk.name, attr_path, CASE WHEN attr_path NOT LIKE '%.%' THEN attr_path END FROM evk JOIN pk USING (nk)""")
def imported_terms(c: Catalog) -> DataFrame:
    return _arrived(c)["search_terms"]


@query(_EVALS + """SELECT commit_seq, system, CASE WHEN heads.system IS NOT NULL THEN TIMESTAMP '2026-06-01' ELSE imported_at END AS imported_at
FROM im LEFT JOIN heads USING (system, commit_seq) WHERE commit_seq <= coalesce((SELECT h.commit_seq FROM heads h WHERE h.system = im.system), 2147483647) GROUP BY ALL""")
def imported_systems(c: Catalog) -> DataFrame:
    return _arrived(c)["commit_systems"].select("commit_seq", "system", "imported_at").distinct()


_DATED = """, rows_ AS (SELECT system, commit_seq, name_key, version, attr_path, max(lower(content_hash)) AS content_hash FROM stage_variants WHERE store_hash <> '' GROUP BY ALL),
marked AS (SELECT *, CASE WHEN content_hash IS DISTINCT FROM lag(content_hash) OVER w THEN 1 ELSE 0 END AS new FROM rows_ WINDOW w AS (PARTITION BY system, name_key, version, attr_path ORDER BY commit_seq)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY system, name_key, version, attr_path ORDER BY commit_seq ROWS UNBOUNDED PRECEDING) AS run FROM marked),
dated AS (SELECT system, name_key, version, attr_path, min(commit_seq) AS commit_seq FROM runs GROUP BY system, name_key, version, attr_path, run QUALIFY row_number() OVER (PARTITION BY system, name_key, version, attr_path ORDER BY run DESC) = 1)
"""


@query(_DATED + """SELECT system, commit_seq, name_key, version, attr_path, lower(meta_hash) AS meta_hash, store_hash, store_name, broken, insecure, lower(content_hash) AS content_hash FROM stage_variants JOIN dated USING (system, name_key, version, attr_path, commit_seq) WHERE store_hash <> ''
QUALIFY row_number() OVER (PARTITION BY system, name_key, version, attr_path ORDER BY lower(content_hash) DESC NULLS LAST, store_hash DESC NULLS LAST, lower(meta_hash) DESC NULLS LAST) = 1""")
def dated_contents(c: Catalog) -> DataFrame:
    return history.dated_contents(c)


SINCE, THROUGH, PAIR = datetime.datetime(2025, 1, 1), 1195, ["aarch64-linux", "x86_64-linux"]


@query(f""", want AS (SELECT DISTINCT commit_seq, system FROM im WHERE system IN ('aarch64-linux', 'x86_64-linux')
  AND commit_seq IN (SELECT seq FROM co WHERE committed_at >= TIMESTAMP '2025-01-01' AND seq <= {THROUGH})),
have AS (SELECT DISTINCT commit_seq, system FROM stage_keys)
SELECT commit_seq, system, 'missing' AS problem FROM want WHERE (commit_seq, system) NOT IN (SELECT (commit_seq, system) FROM have)
UNION ALL SELECT commit_seq, system, 'extra' FROM have WHERE (commit_seq, system) NOT IN (SELECT (commit_seq, system) FROM want)""")
def incomplete_evaluations(c: Catalog) -> DataFrame:
    return merge.incomplete_evaluations(c, c.raw("stage_keys"), PAIR, SINCE, THROUGH)


@query(r""", r AS (SELECT DISTINCT row_id, system, regexp_replace(lower(commit_hash), '^\s+|\s+$', '', 'g') AS h FROM variant_rows)
SELECT row_id, system, seq AS first_seq, seq AS last_seq FROM r JOIN co ON lower(co.hash) = h""")
def seeded_ranges(c: Catalog) -> DataFrame:
    return merge.seeded_ranges(c)


@query("SELECT hash, row_number() OVER (ORDER BY committed_at, hash)::int AS seq FROM (SELECT DISTINCT hash, committed_at FROM co)")
def numbered_commits(c: Catalog) -> DataFrame:
    return merge.numbered_commits(c.commits("seq", "hash", "committed_at"))


_SEED = r""", rec AS (SELECT DISTINCT nfc_normalize(lower(split_part(version_key, chr(9), 1))) AS nk, split_part(version_key, chr(9), 1) AS name,
  substr(version_key, strpos(version_key, chr(9)) + 1) AS version, system, attr_path, regexp_replace(lower(meta_hash), '^\s+|\s+$', '', 'g') AS mh,
  regexp_replace(lower(commit_hash), '^\s+|\s+$', '', 'g') AS ch, regexp_replace(lower(content_hash), '^\s+|\s+$', '', 'g') AS hh, store_hash, store_name
  FROM variant_rows WHERE strpos(version_key, chr(9)) > 1 AND substr(version_key, strpos(version_key, chr(9)) + 1) <> ''),
tl AS (SELECT lower(hash) AS h, row_number() OVER (ORDER BY committed_at, hash)::int AS seq FROM (SELECT DISTINCT hash, committed_at FROM co))
"""


@query(_SEED + """SELECT label, n AS got, n AS want FROM (
  SELECT 'packages' AS label, count(DISTINCT nk) AS n FROM rec UNION ALL SELECT 'versions', count(*) FROM (SELECT DISTINCT nk, version FROM rec)
  UNION ALL SELECT 'variants', count(*) FROM (SELECT DISTINCT nk, version, system, attr_path FROM rec)
  UNION ALL SELECT 'search_terms', count(*) FROM (SELECT DISTINCT nk, attr_path FROM rec)
  UNION ALL SELECT 'variant_ranges', count(*) FROM (SELECT DISTINCT nk, version, system, attr_path FROM rec JOIN tl ON h = ch))""")
def seed_counts(c: Catalog) -> DataFrame:
    records = seeding.seed_records(c.raw("variant_rows"))
    return seeding.seed_report(records, seeding.seeded(records, c.commits("seq", "hash", "committed_at")))


@query(_SEED + """, b AS (SELECT nk, name FROM (SELECT nk, name, count(*) AS n FROM rec GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY nk ORDER BY n DESC, name) = 1),
one AS (SELECT rec.*, seq FROM rec LEFT JOIN tl ON h = ch QUALIFY row_number() OVER (PARTITION BY nk, version, system, attr_path ORDER BY seq DESC NULLS LAST, hh DESC NULLS LAST, rec.name) = 1)
SELECT b.name, version, system, attr_path, seq AS commit_seq, hh AS content_hash FROM one JOIN b USING (nk)""")
def seeded_variants(c: Catalog) -> DataFrame:
    t = seeding.seeded(seeding.seed_records(c.raw("variant_rows")), c.commits("seq", "hash", "committed_at"))
    versions = t["versions"].select(F.col("id").alias("version_id"), "package_id", "version").join(t["packages"].withColumnRenamed("id", "package_id"), "package_id")
    return t["variants"].join(versions, "version_id").select("name", "version", "system", "attr_path", "commit_seq", "content_hash")


# ---------------------------------------------------------------- bookkeeping


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM (SELECT DISTINCT * FROM {t})" for t in status.COUNTED) + ")")
def row_counts(c: Catalog) -> DataFrame:
    return status.row_counts(c)


@query("""SELECT system, imports, newest_seq, (SELECT max(seq) FROM co) - newest_seq AS behind, nix_version, last_import_at, co.hash AS commit_hash, committed_at FROM (
  SELECT system, count(DISTINCT commit_seq) AS imports, max(commit_seq) AS newest_seq, max(imported_at) AS last_import_at,
    first(nix_version ORDER BY commit_seq DESC, imported_at DESC) AS nix_version FROM im GROUP BY 1) JOIN co ON co.seq = newest_seq""")
def system_status(c: Catalog) -> DataFrame:
    return status.system_status(c)


@query("""SELECT 'oldest' AS place, seq, hash, committed_at FROM co WHERE seq = (SELECT min(seq) FROM co)
UNION ALL SELECT 'newest', seq, hash, committed_at FROM co WHERE seq = (SELECT max(seq) FROM co)""".join([", one AS (SELECT 1) ", ""]))
def commit_ends(c: Catalog) -> DataFrame:
    return status.commit_ends(c)


@query("""SELECT seq, hash, string_agg(s, ',' ORDER BY s) AS missing FROM co CROSS JOIN (VALUES ('aarch64-darwin'), ('x86_64-darwin'), ('x86_64-linux')) x(s)
WHERE (seq, s) NOT IN (SELECT (commit_seq, system) FROM im) GROUP BY ALL""")
def incomplete_commits(c: Catalog) -> DataFrame:
    return status.incomplete_commits(c, ["aarch64-darwin", "x86_64-darwin", "x86_64-linux"])


@query("SELECT package_id, name FROM pk WHERE package_id > 300 ORDER BY package_id LIMIT 200")
def package_page(c: Catalog) -> DataFrame:
    return status.page_after(c, 300, 200)


@query("SELECT package_id AS after FROM pk ORDER BY package_id LIMIT 1 OFFSET 399")
def package_page_start(c: Catalog) -> DataFrame:
    return status.page_start(c, 5, 100)


@query("SELECT package_id, ((row_number() OVER (ORDER BY package_id) - 1) // 100)::int AS batch FROM pk")
def package_batches(c: Catalog) -> DataFrame:
    return status.batches(c.packages("package_id"), ["package_id"], 100)


#: Before this moment the listing knows the commits that it names.
LISTED_UNTIL = datetime.datetime(2025, 6, 1)


def _releases(c: Catalog) -> DataFrame:
    """A listing of releases made from all commits: hashes cut to 7 to 11 characters; of those committed later than ``LISTED_UNTIL`` the catalog has other hashes, so that they are new to it."""
    later = F.col("committed_at") > F.lit(LISTED_UNTIL)
    named = F.when(later, F.expr("left(sha1(hash), 9)")).otherwise(F.expr("left(hash, 7 + seq % 5)"))
    return c.commits("seq", "hash", "committed_at").select(named.alias("short_hash"), (F.col("seq") * 10).alias("number"))


@query(""", rel AS (SELECT CASE WHEN committed_at > TIMESTAMP '2025-06-01' THEN left(sha1(hash), 9) ELSE left(hash, 7 + seq % 5) END AS short_hash, seq * 10 AS number FROM co),
known AS (SELECT DISTINCT left(hash, n) AS short_hash FROM co, (SELECT DISTINCT length(short_hash) AS n FROM rel)),
head AS (SELECT coalesce(max(number), 0) AS head FROM rel WHERE short_hash IN (SELECT short_hash FROM known))
SELECT short_hash, number FROM rel, head WHERE number > head AND short_hash NOT IN (SELECT short_hash FROM known) ORDER BY number LIMIT 4""")
def pending_commits(c: Catalog) -> DataFrame:
    return status.pending_commits(c, _releases(c))


@query(""", o AS (SELECT hash, seq AS number FROM co WHERE seq IN (SELECT seq FROM co WHERE (seq, 'x86_64-darwin') NOT IN (SELECT (commit_seq, system) FROM im))),
p AS (SELECT hash, seq AS number FROM co)
SELECT hash, number, turn FROM (SELECT hash, number, 0 AS turn FROM o UNION ALL SELECT hash, number, 1 FROM p WHERE hash NOT IN (SELECT hash FROM o)) ORDER BY turn, number""")
def backfill_first(c: Catalog) -> DataFrame:
    old = status.incomplete_commits(c, ["x86_64-darwin"]).select("hash", F.col("seq").alias("number"))
    return status.with_backfill(old, c.commits("seq", "hash").select("hash", F.col("seq").alias("number")), None)


@query(""", u AS (SELECT nk, name, count(*) AS n FROM pk JOIN ve USING (package_id) GROUP BY ALL)
SELECT name AS spelling, (count(*) OVER (PARTITION BY nk))::bigint AS spellings FROM u QUALIFY row_number() OVER (PARTITION BY nk ORDER BY n DESC, name) = 1""")
def canonical_spellings(c: Catalog) -> DataFrame:
    return status.canonical_spellings(c).select("spelling", "spellings")


@query(""", r AS (SELECT version_id, package_id, row_number() OVER (PARTITION BY package_id ORDER BY sort_key, version_id)::int AS old,
  row_number() OVER (PARTITION BY package_id ORDER BY semver_major, semver_minor, semver_patch, version_id)::int AS new FROM ve WHERE semver_major IS NOT NULL)
SELECT version_id, before FROM (SELECT version_id, new, max(new) OVER (PARTITION BY package_id ORDER BY old ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r) WHERE before > new""")
def order_divergences(c: Catalog) -> DataFrame:
    w = lambda *by: F.row_number().over(Window.partitionBy("package_id").orderBy(*by, F.asc("version_id")))
    ranked = c.versions("version_id", "package_id", "sort_key", "semver_major", "semver_minor", "semver_patch", "semver_pre").where(F.col("semver_major").isNotNull()).select(
        *["version_id", "package_id"], w(F.asc_nulls_last("sort_key")).alias("old"), w(*(F.asc(f"semver_{x}") for x in ("major", "minor", "patch"))).alias("new")
    )
    return status.order_divergences(ranked, "package_id", "old", "new", "version_id")


# ---------------------------------------------------------------- responses and formats

_RELEASES = """, spot AS (SELECT *, CASE WHEN system IN ('aarch64-darwin', 'aarch64-linux') THEN 'arm64' WHEN system IN ('x86_64-darwin', 'x86_64-linux') THEN 'x86-64' ELSE '' END AS arch,
  CASE WHEN system IN ('aarch64-darwin', 'x86_64-darwin') THEN 'macOS' WHEN system IN ('aarch64-linux', 'x86_64-linux') THEN 'Linux' ELSE '' END AS os
  FROM va JOIN ve USING (version_id) JOIN pk USING (package_id) JOIN me USING (meta_id) JOIN co ON co.seq = va.commit_seq),
kept AS (SELECT version_id, max(committed_at) AS newest, string_agg(system || '=' || attr_path, ',' ORDER BY system) AS platforms
  FROM (FROM spot QUALIFY row_number() OVER (PARTITION BY version_id, arch, os ORDER BY system, attr_path) = 1) GROUP BY 1),
whole AS (SELECT version_id, any_value(version) AS version, bool_and(coalesce(broken, false)) AS broken, bool_and(coalesce(insecure, false)) AS insecure,
  bool_or(os = 'Linux') AS linux, bool_or(system = 'aarch64-darwin') AS arm, bool_or(system = 'x86_64-darwin') AS intel FROM spot GROUP BY 1)
"""


@query(_RELEASES + """SELECT version_id, version, strftime(newest, '%Y-%m-%dT%H:%M:%SZ') AS last_updated, platforms, broken, insecure,
  concat_ws(' and ', CASE WHEN linux THEN 'Linux' END, CASE WHEN arm AND intel THEN 'macOS' WHEN arm THEN 'macOS (Apple Silicon only)' WHEN intel THEN 'macOS (Intel only)' END) AS platforms_summary
FROM whole JOIN kept USING (version_id)""")
def release_rows(c: Catalog) -> DataFrame:
    rows = render.release_rows(lookup.result_rows(c, c.shown_variants()))
    listed = F.array_join(F.transform("platforms", lambda p: F.concat(p["system"], F.lit("="), p["attribute_path"])), ",")
    return rows.select("version_id", "version", "last_updated", listed.alias("platforms"), "broken", "insecure", "platforms_summary")


@query("""SELECT version_id, lag(version) OVER w AS newer, lead(version) OVER w AS older FROM ve WINDOW w AS (PARTITION BY package_id ORDER BY sort_key DESC NULLS LAST, version, version_id)""")
def release_neighbours(c: Catalog) -> DataFrame:
    return render.release_neighbours(c.versions("version_id", "package_id", "version", "sort_key")).select("version_id", "newer", "older")


@query(f"""SELECT version_id, system, string_agg(attr_path, ',' ORDER BY attr_path, program, committed_at) AS attr_paths,
  coalesce(string_agg(program, ',' ORDER BY attr_path, program, committed_at) FILTER (WHERE program <> ''), '') AS programs,
  floor(epoch(first(committed_at ORDER BY attr_path, program, committed_at)))::bigint AS last_updated,
  array_to_string(list_filter(first(platforms ORDER BY attr_path, program, committed_at), lambda p: p IN ('aarch64-darwin', 'aarch64-linux', 'x86_64-darwin', 'x86_64-linux')), ',') AS platforms
FROM {_WIDE} GROUP BY version_id, system""")
def legacy_versions(c: Catalog) -> DataFrame:
    return render.legacy_versions(lookup.result_rows(c, c.shown_variants())).select("version_id", "system", "attr_paths", "programs", "last_updated", "platforms")


_WITHOUT_NULLS = """regexp_replace({0}, ',"[a-z_]+":null', '', 'g')"""


@query(_HIT.format("vessimur") + _RELEASES.rstrip() + """,
found AS (SELECT * FROM spot WHERE variant_id IN (FROM hit)),
own AS (SELECT found.*, co.hash AS rev, strftime(found.committed_at, '%Y-%m-%dT%H:%M:%SZ') AS date FROM found JOIN co ON co.seq = found.commit_seq QUALIFY row_number() OVER (PARTITION BY version_id, arch, os ORDER BY system, attr_path) = 1),
listed AS (
  SELECT version_id, max(date) AS last_updated, string_agg(to_json({'system': system, 'arch': arch, 'os': os, 'attribute_path': attr_path, 'commit_hash': rev, 'date': date, 'broken': broken, 'insecure': insecure})::varchar, ',' ORDER BY system, arch, os, attr_path) AS platforms
  FROM own GROUP BY 1),
facts AS (
  SELECT version_id, bool_and(coalesce(broken, false)) AS broken, bool_and(coalesce(insecure, false)) AS insecure, concat_ws(' and ', CASE WHEN bool_or(os = 'Linux') THEN 'Linux' END,
    CASE WHEN bool_or(system = 'aarch64-darwin') AND bool_or(system = 'x86_64-darwin') THEN 'macOS' WHEN bool_or(system = 'aarch64-darwin') THEN 'macOS (Apple Silicon only)' WHEN bool_or(system = 'x86_64-darwin') THEN 'macOS (Intel only)' END) AS said
  FROM found GROUP BY 1),
rel AS (
  SELECT string_agg('{"version":' || to_json(version)::varchar || ',"last_updated":"' || last_updated || '","platforms":[' || platforms || '],"platforms_summary":' || to_json(said)::varchar
    || ',"prerelease":' || prerelease::varchar || ',"broken":' || facts.broken::varchar || ',"insecure":' || facts.insecure::varchar || '}', ',' ORDER BY sort_key DESC NULLS LAST, version, version_id) AS releases
  FROM ve JOIN listed USING (version_id) JOIN facts USING (version_id)),
head AS (FROM found ORDER BY sort_key DESC NULLS LAST, version, version_id, system, attr_path, variant_id LIMIT 1)
SELECT """ + _WITHOUT_NULLS.format("""rtrim(to_json({'name': name, 'summary': summary, 'description': description, 'homepage_url': homepage, 'license': license})::varchar, '}')
  || ',"attribute_paths":' || (SELECT to_json(list_sort(list(DISTINCT attr_path)))::varchar FROM found) || ',"releases":[' || releases || ']}'""") + " AS document FROM head, rel")
def package_document(c: Catalog) -> DataFrame:
    return render.package_document(lookup.versions_by_name(c, "vessimur"))


@query(_HIT.format("vessimur").rstrip() + """, candidates AS (
  SELECT version_id, version, sort_key, coalesce(semver_major IS NOT NULL AND coalesce(semver_pre, '') = '' AND [semver_major, semver_minor, semver_patch] >= [1,16,0] AND semver_major < 2, false) AS fits
  FROM va JOIN hit USING (variant_id) JOIN ve USING (version_id)),
best AS (SELECT version_id FROM candidates WHERE fits OR version = '^1.16' OR starts_with(version, '^1.16.') OR starts_with(version, '^1.16-') ORDER BY fits DESC, sort_key DESC NULLS LAST, version, version_id LIMIT 1),
own AS (SELECT * FROM va WHERE version_id IN (FROM best) QUALIFY row_number() OVER (PARTITION BY version_id, system ORDER BY attr_path, variant_id) = 1),
spans AS (
  SELECT version_id, system, first_seq AS lo, coalesce(last_seq, (SELECT max(commit_seq) FROM im WHERE im.system = own.system)) AS hi FROM ra JOIN own USING (variant_id) WHERE NOT coalesce(seeded, false)),
good AS (SELECT DISTINCT * FROM spans WHERE lo <= hi),
met AS (SELECT a.hi, count(DISTINCT b.system) AS n FROM good a JOIN good b ON b.lo <= a.hi AND a.hi <= b.hi GROUP BY 1),
common AS (SELECT max(hi) AS seq FROM met WHERE n = (SELECT count(DISTINCT system) FROM good) AND n >= 2),
rows_ AS (
  SELECT name, version, summary, va.system, attr_path, coalesce(k.hash, co.hash) AS rev, strftime(coalesce(k.committed_at, co.committed_at), '%Y-%m-%dT%H:%M:%SZ') AS updated
  FROM """ + _WIDE + """ LEFT JOIN (SELECT DISTINCT system, co.hash, co.committed_at FROM good, common JOIN co ON co.seq = common.seq) k ON k.system = va.system
  WHERE version_id IN (FROM best) QUALIFY row_number() OVER (PARTITION BY va.system ORDER BY attr_path) = 1)
SELECT '{"name":' || to_json(min(name))::varchar || ',"version":' || to_json(min(version))::varchar || coalesce(',"summary":' || to_json(min(summary))::varchar, '')
  || ',"systems":{' || string_agg('"' || system || '":{"attr_path":' || to_json(attr_path)::varchar || ',"rev":"' || rev || '","last_updated":"' || updated || '"}', ',' ORDER BY system) || '}}' AS document
FROM rows_ HAVING count(*) > 0""")
def resolve_document(c: Catalog) -> DataFrame:
    return render.resolve_document(history.at_common_commit(c, lookup.resolve(c, "vessimur", "^1.16")))


@query(_ranked("ocavel").rstrip() + _latest("package_id") + f""", chosen AS (SELECT ord, version_id FROM ranked JOIN hits USING (package_id) WHERE place = 1),
rows_ AS (SELECT ord, version_id, name, summary, strftime(committed_at, '%Y-%m-%dT%H:%M:%SZ') AS updated, version, attr_path FROM {_WIDE} JOIN chosen USING (version_id) QUALIFY row_number() OVER (PARTITION BY ord ORDER BY va.system, attr_path) = 1),
sy AS (SELECT version_id, list_sort(list(DISTINCT system)) AS systems FROM va GROUP BY 1)
""" + """SELECT '{"query":"ocavel","total_results":' || count(*) || ',"results":[' || coalesce(string_agg(""" + _WITHOUT_NULLS.format(
    "to_json({'name': name, 'summary': summary, 'last_updated': updated, 'version': version, 'attribute_path': attr_path, 'systems': systems})::varchar"
) + """, ',' ORDER BY ord), '') || ']}' AS document FROM rows_ JOIN sy USING (version_id)""")
def search_document(c: Catalog) -> DataFrame:
    return render.search_document(phrase.search_phrase(c, "ocavel", releases=3), "ocavel")


@query(_HIT.format("ocavelPackages.core").rstrip() + f""", listed AS (SELECT name, version, row_number() OVER (ORDER BY sort_key DESC NULLS LAST, version, version_id) AS n FROM {_WIDE} WHERE variant_id IN (FROM hit)),
marked AS (SELECT *, CASE WHEN n > 1 AND name IS DISTINCT FROM lag(name) OVER (ORDER BY n) THEN 1 ELSE 0 END AS new FROM listed),
runs AS (SELECT *, sum(new) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING)::int AS run FROM marked)
SELECT run, name, count(DISTINCT version) AS num_versions FROM runs GROUP BY ALL""")
def listing_by_name(c: Catalog) -> DataFrame:
    """The runs of names in a listing by attribute path, where spellings and packages interleave."""
    return render.grouped_by_name(lookup.versions_by_name(c, "ocavelPackages.core"), lookup.release_order())


@query(P6_LEAVES + """, outs AS (
  SELECT raw_id, item AS name, string_split(system, '-')[2] AS os, system, coalesce(is_default, false) AS d FROM items JOIN (SELECT DISTINCT raw_id, system FROM raw_records) USING (raw_id)
  WHERE "table" IN ('outputs_single', 'outputs_array') QUALIFY row_number() OVER (PARTITION BY raw_id, item, system ORDER BY ordinal DESC) = 1),
ones AS (SELECT raw_id, name, bool_or(d) AS d, coalesce(bool_or(os = 'linux'), false) AS linux, coalesce(bool_or(os = 'darwin'), false) AS darwin FROM outs GROUP BY 1, 2)
SELECT raw_id, CASE WHEN bool_and(d) THEN '' ELSE string_agg(CASE WHEN darwin AND linux THEN name WHEN darwin THEN name || ' (macOS only)' WHEN linux THEN name || ' (Linux only)' ELSE '' END, ', ' ORDER BY d DESC, name) END AS outputs_summary
FROM ones GROUP BY 1""", base=False)
def outputs_summaries(c: Catalog) -> DataFrame:
    flat = shred(c.raw("raw_records").where(F.col("shape") == "latest"))
    both = flat.where(F.col("table").isin("outputs_array", "outputs_single"))  # a single output is an array of one
    outputs = both.select("raw_id", F.col("item").alias("name"), "is_default", "ordinal").distinct()
    systems = c.raw("raw_records").select("raw_id", "system").distinct()
    return render.outputs_summary(outputs.join(systems, "raw_id"), ["raw_id"], ["ordinal"])


#: The field of ``meta`` with versions that names don't have, as this query's producers would name it.
HIDDEN_VERSION = "_hiddenVersion"


@query(decoded_sql(HIDDEN_VERSION), base=False)
def decoded_packages(c: Catalog) -> DataFrame:
    rows = decode_packages(c.raw("raw_records").select("raw_id", "shape", "payload").distinct(), HIDDEN_VERSION)  # copies of a record, not paths that clean alike
    return rows.withColumn("platforms", pipe("platforms")).withColumn("outputs", F.to_json("outputs"))


@query("SELECT package_id, '<url><loc>https://catalog.example/pkg/' || url_encode(name) || '</loc></url>' AS line FROM pk")
def site_map(c: Catalog) -> DataFrame:
    return render.site_map(c.packages("package_id", "name"), "https://catalog.example")


@query(r"""SELECT variant_id, arch.arch AS arch, arch.os AS os, top, known FROM (
  SELECT variant_id, CASE system WHEN 'aarch64-darwin' THEN {'arch': 'arm64', 'os': 'macOS'} WHEN 'aarch64-linux' THEN {'arch': 'arm64', 'os': 'Linux'}
    WHEN 'x86_64-darwin' THEN {'arch': 'x86-64', 'os': 'macOS'} WHEN 'x86_64-linux' THEN {'arch': 'x86-64', 'os': 'Linux'} ELSE {'arch': '', 'os': ''} END AS arch,
    CASE WHEN attr_path NOT LIKE '%.%' THEN attr_path END AS top, system IN ('aarch64-darwin', 'aarch64-linux', 'x86_64-darwin', 'x86_64-linux') AS known FROM va)""".join([", one AS (SELECT 1) ", ""]))
def systems_and_paths(c: Catalog) -> DataFrame:
    s = arch_os(F.col("system"))
    return c.variants("variant_id", "system", "attr_path").select("variant_id", s["arch"].alias("arch"), s["os"].alias("os"), top_level(F.col("attr_path")).alias("top"), supported(F.col("system")).alias("known"))


_RULES = [("family", r"^pyrennet[0-9]*$"), ("family-packages", r"^pyrennet[0-9]+Packages\..+$"), ("core", r"^ocavelPackages\.core$")]


@query(r""", paths AS (SELECT DISTINCT attr_path FROM va) SELECT attr_path, CASE WHEN regexp_matches(attr_path, '^pyrennet[0-9]*$') THEN 'family'
  WHEN regexp_matches(attr_path, '^pyrennet[0-9]+Packages\..+$') THEN 'family-packages' WHEN regexp_matches(attr_path, '^ocavelPackages\.core$') THEN 'core' ELSE attr_path END AS name FROM paths""")
def canonical_names(c: Catalog) -> DataFrame:
    return c.variants("attr_path").distinct().select("attr_path", canonical_name(F.col("attr_path"), _RULES).alias("name"))


@query(r""", s AS (SELECT variant_id, '/nix/store/' || store_hash || '-' || meta_name AS path, meta_name AS n FROM va WHERE length(store_hash) = 32),
r AS (SELECT *, regexp_matches(n, '(?s)^.+?-\P{L}.*$') AS parted FROM s)
SELECT variant_id, substr(path, 12, 32) AS hash, CASE WHEN parted THEN regexp_extract(n, '(?s)^(.+?)-(\P{L}.*)$', 1) ELSE n END AS name,
  CASE WHEN parted THEN regexp_extract(n, '(?s)^(.+?)-(\P{L}.*)$', 2) ELSE '' END AS version FROM r""")
def store_paths(c: Catalog) -> DataFrame:
    path = F.concat(F.lit("/nix/store/"), "store_hash", F.lit("-"), "meta_name")
    p = split_store_path(path)
    return c.variants("variant_id", "store_hash", "meta_name").where(F.length("store_hash") == 32).select("variant_id", p["hash"].alias("hash"), p["name"].alias("name"), p["version"].alias("version"))


@query("""SELECT seq, strftime(committed_at, '%Y-%m-%dT%H:%M:%SZ') AS rfc3339, floor(epoch(committed_at))::bigint AS seconds,
  'x86_64-linux/' || floor(epoch(committed_at))::bigint || '-' || hash || '.json.gz' AS archive FROM co""")
def commit_times(c: Catalog) -> DataFrame:
    at = F.col("committed_at")
    return c.commits("seq", "hash", "committed_at").select("seq", rfc3339(at).alias("rfc3339"), unix_seconds(at).alias("seconds"), archive_key(F.lit("x86_64-linux"), at, F.col("hash")).alias("archive"))


@query(r"""SELECT meta_id, replace(replace(replace(replace(replace(summary, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
  regexp_replace(summary, '([\\%_])', '\\\1', 'g') AS pattern, sha256(description) AS digest, url_encode(summary) AS segment FROM me""")
def escaped_text(c: Catalog) -> DataFrame:
    s = F.col("summary")
    return c.meta("meta_id", "description", "summary").select("meta_id", escape_html(s).alias("html"), escape_like(s).alias("pattern"), F.sha2("description", 256).alias("digest"), url_segment(s).alias("segment"))


@query(r"""SELECT version_id, concat_ws(chr(9), version_id::varchar, replace(version, '\', '\\'), CASE WHEN sort_key IS NULL THEN '\N' ELSE '\\x' || lower(hex(sort_key)) END,
  CASE WHEN prerelease IS NULL THEN '\N' WHEN prerelease THEN 't' ELSE 'f' END, coalesce(semver_major::varchar, '\N')) AS line FROM ve""")
def copy_lines(c: Catalog) -> DataFrame:
    rows = c.versions("version_id", "version", "sort_key", "prerelease", "semver_major")
    return rows.select("version_id", copy_line(rows.dtypes).alias("line"))


_HTML = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_UNIT = "WHEN {0} < {1} THEN {0} || ' {2}' || CASE WHEN {0} = 1 THEN '' ELSE 's' END || ' ago'"


@query(""", m AS (SELECT *, strpos(lower(summary), 'pa') AS hit, meta_id * 977 AS n, epoch(TIMESTAMP '2026-01-01')::bigint - (1700000000 + meta_id * 40000) AS gone FROM me),
steps AS (SELECT *, floor(gone / 60 + 0.5)::bigint AS mins, floor(mins / 60 + 0.5)::bigint AS hours, floor(hours / 24 + 0.5)::bigint AS days FROM m),
longer AS (SELECT *, floor(days / 30.4 + 0.5)::bigint AS months, floor(days / 365.25 + 0.5)::bigint AS years, sha256(summary) AS digest FROM steps)
SELECT meta_id, CASE WHEN hit > 0 THEN """ + " || ".join([_HTML.format("left(summary, hit - 1)"), "'<mark>'", _HTML.format("substr(summary, hit, 2)"), "'</mark>'", _HTML.format("substr(summary, hit + 2)")]) + " ELSE " + _HTML.format("summary") + """ END AS highlight,
  left(translate(to_base64(unhex(digest)), '+/', '-_'), 27) AS etag,
  '{' || array_to_string([x FOR x IN ['"summary":' || to_json(nullif(summary, ''))::varchar, '"license":' || to_json(nullif(license, ''))::varchar, '"homepage":' || to_json(nullif(homepage, ''))::varchar,
    CASE WHEN len(platforms) > 0 THEN '"platforms":' || to_json(platforms)::varchar END] IF x IS NOT NULL AND NOT ends_with(x, ':null')], ',') || '}' AS document,
  CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', floor(n / 1024 * 10 + 0.5) / 10) ELSE printf('%.1f MiB', floor(n / 1048576 * 10 + 0.5) / 10) END AS size, format('{:,}', n) AS shown,
  CASE WHEN gone < 0 THEN 'in the future' WHEN gone < 60 THEN 'just now' """ + " ".join([_UNIT.format("mins", 60, "minute"), _UNIT.format("hours", 24, "hour"), _UNIT.format("days", 60, "day"), _UNIT.format("months", 24, "month"), _UNIT.format("years", 10000, "year")]) + """ END AS age,
  concat_ws(' && ', CASE WHEN license <> '' THEN 'phrase = ' || to_json(license)::varchar || ' = ' || to_json('^"' || q || '" OR ^"' || q || '"* OR "' || q || '" OR "' || q || '"*')::varchar END, CASE WHEN summary <> '' THEN 'name = ' || to_json(summary)::varchar END) AS asked,
  CASE WHEN strpos(ref, '@') > 1 THEN split_part(ref, '@', 1) ELSE ref END AS ref_name, CASE WHEN strpos(ref, '@') > 1 THEN substr(ref, strpos(ref, '@') + 1) END AS ref_version,
  CASE WHEN regexp_matches(left(meta_hash, 40), '^[0-9a-f]{7,40}$') THEN 'x86_64-linux' END AS file_system, CASE WHEN regexp_matches(left(meta_hash, 40), '^[0-9a-f]{7,40}$') THEN left(meta_hash, 40) END AS file_commit
FROM (SELECT * EXCLUDE (hash), hash AS meta_hash, replace(license, '"', '""') AS q, summary || '@' || license AS ref FROM longer)""")
def response_texts(c: Catalog) -> DataFrame:
    """The remaining text functions over the metadata: highlights, tags, sizes, ages, queries, references, file names."""
    number = F.col("meta_id").cast("bigint")  # its products exceed an int, and the moments made of it a timestamp
    now = F.lit(int(datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC).timestamp()))
    ref = split_reference(F.concat("summary", F.lit("@"), "license"))
    name = parse_archive_name(F.concat(F.lit("out/eval-x86_64-linux-"), F.substring("meta_hash", 1, 40), F.lit(".json.gz")))
    rows = c.meta("meta_id", "meta_hash", "summary", "license", "homepage", "platforms")
    kinds = [(k, t) for k, t in rows.dtypes if k in ("summary", "license", "homepage", "platforms")]
    return rows.select(
        *["meta_id", highlight(F.col("summary"), "pa").alias("highlight"), etag(F.col("summary")).alias("etag")],
        *[omit_empty(kinds).alias("document"), byte_size(number * 977).alias("size"), integer(number * 977).alias("shown")],
        elapsed(now - (F.lit(1700000000) + number * 40000)).alias("age"),
        describe_query(F.col("license"), F.col("summary"), F.lit(""), F.lit(None).cast("string")).alias("asked"),
        *[ref["name"].alias("ref_name"), ref["version"].alias("ref_version"), name["system"].alias("file_system"), name["commit"].alias("file_commit")],
    )


@query(latest_sql(), base=False)
def latest_contents(c: Catalog) -> DataFrame:
    """Records of the other shape under the content addresses that an evaluation of the same package has."""
    rows = decode_latest(c.raw("raw_records").select("raw_id", "shape", "payload").distinct())
    return rows.select(*"raw_id attr_path system commit_hash store_hash summary broken insecure".split(), F.array_join("meta_version", "|").alias("meta_version"), "meta_hash", "content_hash")


def _sql_fields(fields: dict[str, tuple[str, str]]) -> str:
    """The JSON object of fields (value, condition under which it is there), without its braces."""
    return "array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN {when} THEN '\"{k}\":' || to_json({v})::varchar END" for k, (v, when) in fields.items()) + "] IF x IS NOT NULL], ',')"


_SHARED = {"commit_hash": ("rev", "rev <> ''"), "last_updated": ("updated", "updated <> 0"), "version": ("version", "version <> ''"), "platforms": ("systems", "len(systems) > 0"), **{k: (k, f"{k} <> ''") for k in ("summary", "description", "homepage", "license")}}
_OWN = {**{k: (k, f"{k} <> ''") for k in ("system", "store_hash", "store_name")}, "store_version": ("version", "version <> ''"), "meta_name": ("meta_name", "meta_name <> ''"), "meta_version": ("meta_version", "len(meta_version) > 0"), "attr_paths": ("paths", "true"), "programs": ("programs", "len(programs) > 0"), "broken": ("true", "broken"), "insecure": ("true", "insecure")}


@query(f""", w AS (
  SELECT *, co.hash AS rev, floor(epoch(committed_at))::bigint AS updated, list_filter(platforms, lambda p: p IN ('aarch64-darwin', 'aarch64-linux', 'x86_64-darwin', 'x86_64-linux')) AS systems FROM {_WIDE}),
g AS (SELECT version_id, system, list(attr_path ORDER BY attr_path, variant_id) AS paths, coalesce(list(program ORDER BY attr_path, variant_id) FILTER (program <> ''), []) AS programs FROM w GROUP BY ALL),
f AS (SELECT * FROM w JOIN g USING (version_id, system) QUALIFY row_number() OVER (PARTITION BY version_id, system ORDER BY attr_path, variant_id) = 1),
e AS (SELECT version_id, system, name, {_sql_fields(_SHARED)} AS head, {_sql_fields(_SHARED | _OWN)} AS entry FROM f)
SELECT version_id, '{{' || first(head ORDER BY system) || ',"name":' || to_json(any_value(name))::varchar || ',"systems":{{' || string_agg('"' || system || '":{{' || entry || '}}', ',' ORDER BY system) || '}}}}' AS document FROM e GROUP BY version_id""")
def legacy_documents(c: Catalog) -> DataFrame:
    return render.legacy_documents(lookup.result_rows(c, c.shown_variants())).select("version_id", "document")


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%gZ')"


@query(SQL["latest_for_list"].removeprefix(BASE).replace("SELECT ord, wanted, version, systems, attr_path, last_updated FROM wanted LEFT JOIN facts USING (ord)", "") + f""",
asked AS (SELECT ord, wanted, version, systems, attr_path, last_updated FROM wanted LEFT JOIN facts USING (ord)),
sy AS (SELECT system, count(DISTINCT commit_seq) AS commits, max(commit_seq) AS seq, max(imported_at) AS done, first(nix_version ORDER BY commit_seq DESC, imported_at DESC) AS nix FROM im GROUP BY 1)
SELECT '{{"counts":{{' || (SELECT string_agg('"' || t || '":' || n, ',' ORDER BY t) FROM ({" UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM (SELECT DISTINCT * FROM {t})" for t in status.COUNTED)})) || '}},'
  || (SELECT string_agg('"' || place || '_commit":{{"seq":' || seq || ',"hash":"' || hash || '","committed_at":"' || {_ISO.format("committed_at")} || '"}}', ',' ORDER BY place DESC) FROM (
    SELECT 'oldest' AS place, seq, hash, committed_at FROM co WHERE seq = (SELECT min(seq) FROM co) UNION ALL SELECT 'newest', seq, hash, committed_at FROM co WHERE seq = (SELECT max(seq) FROM co)))
  || ',"last_import_at":"' || (SELECT {_ISO.format("max(done)")} FROM sy) || '","systems":[' || (SELECT string_agg('{{"system":"' || system || '","commits":' || commits || ',"newest":{{"seq":' || sy.seq || ',"hash":"' || hash || '","committed_at":"' || {_ISO.format("committed_at")}
    || '"}}' || coalesce(',"nix_version":"' || nix || '"', '') || '}}', ',' ORDER BY system) FROM sy JOIN co ON co.seq = sy.seq)
  || '],"latest_versions":[' || (SELECT string_agg('{{"name":' || to_json(wanted)::varchar || coalesce(',"version":' || to_json(version)::varchar, '') || coalesce(',"attr_path":' || to_json(attr_path)::varchar, '')
    || ',"systems":' || CASE WHEN systems IS NULL THEN '[]' ELSE to_json(string_split(systems, ','))::varchar END || coalesce(',"last_updated":"' || {_ISO.format("last_updated")} || '"', '') || '}}', ',' ORDER BY ord) FROM asked) || ']}}' AS document""")
def status_document(c: Catalog) -> DataFrame:
    return render.status_document(c, WANTED)


@query("SELECT unnest(range(1, (count(*) + 99) // 100 + 1))::int AS page, '<sitemap><loc>https://catalog.example/sitemaps/' || page || '.xml</loc></sitemap>' AS line FROM pk")
def site_map_index(c: Catalog) -> DataFrame:
    return render.site_map_index(c.packages("package_id", "name"), "https://catalog.example", 100)


@query(f""", m AS (SELECT *, replace(url_encode(name), '%7E', '~') AS seg FROM pk JOIN ve USING (package_id)), v AS (SELECT *, url_encode(version) AS vs FROM m)
SELECT version_id, '/pkg/' || seg AS page, '/pkg/' || seg || '/' || vs AS release, '/v2/resolve?name=' || seg || CASE WHEN version = '' THEN '' ELSE '&version=' || vs END AS resolve FROM v""")
def package_links(c: Catalog) -> DataFrame:
    rows = c.versions("version_id", "package_id", "version").join(c.packages("package_id", "name"), "package_id")
    name, version = F.col("name"), F.col("version")
    return rows.select("version_id", package_path(name).alias("page"), package_path(name, version).alias("release"), query_path(F.lit("/v2/resolve"), name=name, version=version).alias("resolve"))


@query(f"""SELECT seq, '<time datetime="' || {_ISO.format("committed_at")} || '">' || strftime(committed_at, '%Y-%m-%d %H:%M UTC') || '</time>' AS minute,
  '<time datetime="' || {_ISO.format("committed_at")} || '" title="' || {_ISO.format("committed_at")} || '">' || strftime(committed_at, '%Y-%m-%d') || '</time>' AS day FROM co""")
def time_tags(c: Catalog) -> DataFrame:
    return c.commits("seq", "committed_at").select("seq", time_tag(F.col("committed_at")).alias("minute"), day_tag(F.col("committed_at")).alias("day"))


@query("SELECT variant_id, regexp_replace(system, '-', ' ') AS system FROM va")
def short_systems(c: Catalog) -> DataFrame:
    return c.variants("variant_id", "system").select("variant_id", short_system(F.col("system")).alias("system"))


# ---------------------------------------------------------------- the rest


@query(_HIT.format("pyrennet").rstrip() + f""", candidates AS (
  SELECT version_id, version, sort_key, coalesce(semver_major IS NOT NULL AND coalesce(semver_pre, '') = '' AND [semver_major, semver_minor, semver_patch] >= [1,2,0] AND semver_major < 2, false) AS fits
  FROM va JOIN hit USING (variant_id) JOIN ve USING (version_id) WHERE va.system = 'x86_64-linux' AND NOT prerelease),
best AS (SELECT version_id FROM candidates WHERE fits OR version = '^1.2' OR starts_with(version, '^1.2.') OR starts_with(version, '^1.2-') ORDER BY fits DESC, sort_key DESC NULLS LAST, version, version_id LIMIT 1)
SELECT {_ROW} FROM {_WIDE} WHERE version_id IN (FROM best) AND va.system = 'x86_64-linux' AND NOT prerelease ORDER BY va.system, attr_path LIMIT 1000""")
def dispatched_search(c: Catalog) -> DataFrame:
    """A search by name, constraint and system through the one entry, its texts in other case and with blanks around."""
    return _row(lookup.dispatch(c, name=" Pyrennet", version="^1.2 ", system="X86_64-Linux", no_prerelease=True))


@query(_ranked("ocavel").rstrip() + """, listed AS (
  SELECT ord, version, version_id, sort_key, (SELECT list_sort(list(DISTINCT system)) FROM va WHERE va.version_id = ve.version_id) AS systems, row_number() OVER (PARTITION BY ord ORDER BY sort_key DESC NULLS LAST, version, version_id) AS n
  FROM hits JOIN ve USING (package_id) WHERE version_id IN (SELECT version_id FROM va))
SELECT ord, '[' || string_agg(to_json({'version': version, 'systems': systems})::varchar, ',' ORDER BY n) || ']' AS releases FROM listed WHERE n <= 3 GROUP BY 1""")
def phrase_releases(c: Catalog) -> DataFrame:
    return phrase.search_phrase(c, "ocavel", releases="3").select("ord", "releases")


@query(f", tables AS (SELECT {TABLE} AS nfd_of) SELECT package_id, lower({nfd('name')}) AS name_key, {clean('name')} AS decomposed FROM pk, tables")
def name_keys(c: Catalog) -> DataFrame:
    return c.packages("package_id", "name", "name_key").select("package_id", "name_key", nfd_of(F.col("name")).alias("decomposed"))


@query("""SELECT seq, 'r/' || (seq * 10) || '.' || left(hash, 7 + seq % 5) || '/' AS prefix, 'page' || seq AS token, left(hash, 12) AS commit FROM co""")
def listed_releases(c: Catalog) -> DataFrame:
    """Pages of a release listing, one for each commit, and the file names of its evaluations, read again."""
    prefix = F.concat(F.lit("r/"), (F.col("seq") * 10).cast("string"), F.lit("."), F.expr("left(hash, 7 + seq % 5)"), F.lit("/"))
    page = F.concat(F.lit("<List><Prefix>"), prefix, F.lit("</Prefix><Next>page"), F.col("seq").cast("string"), F.lit("</Next></List>"))
    file = parse_archive_name(F.concat(F.lit("out/hidden-x86_64-linux-"), F.expr("left(hash, 12)"), F.lit(".json.gz")))
    return c.commits("seq", "hash").select("seq", listed_prefixes(page)[0].alias("prefix"), xml_tag(page, "Next").alias("token"), file["commit"].alias("commit"))


@query(SQL["prerelease_flags"].removeprefix(BASE).replace("SELECT version_id,", ", flags AS (SELECT version_id, version, prerelease AS stored,", 1).replace("AS prerelease FROM ve", "AS computed FROM ve)") + " SELECT version_id, version, stored, computed FROM flags WHERE stored IS DISTINCT FROM computed")
def prerelease_divergences(c: Catalog) -> DataFrame:
    return status.prerelease_divergences(c)


__all__ = ["QUERIES", "SQL"]
