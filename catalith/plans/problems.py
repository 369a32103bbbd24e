"""The general data-preparation queries over the catalog's tables, with their SQL where SQL can state them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.names import blank_trimmed, name_key
from catalith.operators.dense import dense_sums
from catalith.operators.intervals import OPEN_END, continuous_periods
from catalith.operators.nested import CHILD_TABLES, child_items, shred, subtype_table
from catalith.operators.references import Reference, orphan_counts, orphan_references
from catalith.operators.snapshots import imported_only, snapshot_changes
from catalith.sources.tables import table

# ---------------------------------------------------------------- 1


def backfill_of_variants(spark: SparkSession, base: str) -> DataFrame:
    """``(variant_id, first_seq, last_seq)`` of stage_backfill_ranges, whose keys are resolved to variants.

    A key that no variant has gives nothing, one that several have counts for each.
    """
    key = ["system", "name_key", "version", "attr_path"]
    staged = table(spark, base, "stage_backfill_ranges").select(*key, "first_seq", "last_seq").distinct()
    packages = table(spark, base, "packages").select(F.col("id").alias("package_id"), name_key(F.col("name")).alias("name_key")).distinct()
    versions = table(spark, base, "versions").select(F.col("id").alias("version_id"), "package_id", "version").distinct()
    variants = table(spark, base, "variants").select(F.col("id").alias("variant_id"), "version_id", "system", "attr_path").distinct()
    keys = staged.select(*key).distinct().join(packages, "name_key").join(versions, ["package_id", "version"])
    keys = keys.join(variants, ["version_id", "system", "attr_path"]).select("variant_id", *key)
    return keys.join(staged, key).select("variant_id", "first_seq", "last_seq")


def p1_found(spark: SparkSession, base: str, **limits: int) -> DataFrame:
    ranges = table(spark, base, "variant_ranges").where(~F.coalesce("seeded", F.lit(False)))
    ranges = ranges.select("variant_id", "first_seq", "last_seq").unionByName(backfill_of_variants(spark, base))
    imports = table(spark, base, "commit_systems").select(F.col("system").alias("scope"), F.col("commit_seq").alias("point"))
    systems = table(spark, base, "variants").select(F.col("id").alias("variant_id"), F.col("system").alias("scope"))
    starts = table(spark, base, "variant_ranges").select("first_seq").unionByName(table(spark, base, "stage_backfill_ranges").select("first_seq"))
    low, high = starts.agg(F.min("first_seq"), F.max("first_seq")).first()
    bounds = None if low is None else (low, high)
    out = continuous_periods(ranges, "variant_id", "first_seq", "last_seq", scope_of=systems, points=imports, bounds=bounds, **limits)
    return out.select("variant_id", "piece", "first_seq", "last_seq")


def p1_split(spark: SparkSession, base: str) -> DataFrame:
    """The same where variants with more than one start are large, so that both ways are taken at any size of the tables."""
    return p1_found(spark, base, entity_starts=1)


P1_SQL = f"""
WITH own AS (
  SELECT variant_id, first_seq, coalesce(last_seq, {OPEN_END}) AS last_seq
  FROM variant_ranges WHERE NOT coalesce(seeded, false)
  UNION
  SELECT v.id, b.first_seq, coalesce(b.last_seq, {OPEN_END})
  FROM stage_backfill_ranges b
  JOIN packages p ON nfc_normalize(lower(p.name)) = nfc_normalize(b.name_key)
  JOIN versions e ON e.package_id = p.id AND e.version = b.version
  JOIN variants v ON v.version_id = e.id AND v.system = b.system AND v.attr_path = b.attr_path),
systems AS (SELECT id, min(system) AS system FROM variants GROUP BY id),
points AS (SELECT DISTINCT system, commit_seq FROM commit_systems),
ranked AS (
  SELECT o.variant_id, o.first_seq, o.last_seq, s.system,
    max(o.last_seq) OVER (PARTITION BY o.variant_id ORDER BY o.first_seq, o.last_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM own o LEFT JOIN systems s ON s.id = o.variant_id WHERE o.last_seq >= o.first_seq),
flagged AS (
  SELECT *, CASE WHEN prev < first_seq AND EXISTS (
      SELECT 1 FROM points c WHERE c.system = ranked.system AND c.commit_seq > prev AND c.commit_seq < first_seq) THEN 1 ELSE 0 END AS new
  FROM ranked),
islands AS (
  SELECT *, sum(new) OVER (PARTITION BY variant_id ORDER BY first_seq, last_seq ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
periods AS (
  SELECT variant_id, min(first_seq) AS first_seq, max(last_seq) AS last_seq FROM islands GROUP BY variant_id, island),
neighbours AS (
  SELECT *, lag(last_seq) OVER (PARTITION BY variant_id ORDER BY first_seq) AS before FROM periods)
SELECT variant_id, 'period' AS piece, first_seq, last_seq FROM periods
UNION ALL
SELECT variant_id, 'gap', before + 1, first_seq - 1 FROM neighbours WHERE before IS NOT NULL
"""

# ---------------------------------------------------------------- 3


def variant_row_orphans(spark: SparkSession, base: str, **limits: int) -> DataFrame:
    rows = table(spark, base, "variant_rows").select("row_id", "version_key", "meta_hash", "commit_hash", "loaded_at")
    hashed = lambda c: blank_trimmed(F.lower(F.col(c)))
    commits = table(spark, base, "commits").select(hashed("hash").alias("key"), F.col("imported_at").alias("arrived"))
    meta = table(spark, base, "meta").select(hashed("hash").alias("key"))
    packages = table(spark, base, "packages").select(F.col("id").alias("package_id"), name_key(F.col("name")).alias("_name")).distinct()
    versions = table(spark, base, "versions").select("package_id", "version").distinct().join(packages, "package_id")
    versions = versions.select(F.concat("_name", F.lit("\t"), "version").alias("key"))  # null, thus no parent, if either is
    name, version = F.substring_index("version_key", "\t", 1), F.expr("substring(version_key, instr(version_key, '\t') + 1)")
    keys = rows.select("version_key").where(F.col("version_key") != "").distinct()
    keyed = F.when(F.instr("version_key", "\t") > 0, F.concat(name_key(name), F.lit("\t"), version)).otherwise(F.col("version_key"))
    # The normalised key of each distinct spelling; a spelling meets its rows in the operator's own join.
    spelled = keys.select("version_key", keyed.alias("_key"))
    known = spelled.join(versions, spelled["_key"] == versions["key"], "left_semi").select(F.col("version_key").alias("key"))
    refs = [
        Reference("commits", hashed("commit_hash"), commits),
        Reference("meta", hashed("meta_hash"), meta),
        Reference("versions", F.col("version_key"), known),
    ]
    return orphan_references(rows, "row_id", refs, period=F.date_format("loaded_at", "yyyy-MM"), moment=F.col("loaded_at"), **limits)


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return variant_row_orphans(spark, base)


def p3_split(spark: SparkSession, base: str) -> DataFrame:
    """The same with hot keys from five rows on, so that both ways are taken at any size of the tables."""
    return variant_row_orphans(spark, base, hot_rows=5)


def p3_counts(spark: SparkSession, base: str) -> DataFrame:
    return orphan_counts(variant_row_orphans(spark, base))


P3_SQL = r"""
WITH r AS (
  SELECT DISTINCT row_id, version_key, strftime(loaded_at, '%Y-%m') AS period, loaded_at,
    regexp_replace(lower(commit_hash), '^\s+|\s+$', '', 'g') AS ch, regexp_replace(lower(meta_hash), '^\s+|\s+$', '', 'g') AS mh
  FROM variant_rows),
c AS (SELECT regexp_replace(lower(hash), '^\s+|\s+$', '', 'g') AS h, min(imported_at) AS arrived FROM commits GROUP BY 1),
m AS (SELECT DISTINCT regexp_replace(lower(hash), '^\s+|\s+$', '', 'g') AS h FROM meta),
e AS (SELECT DISTINCT nfc_normalize(lower(p.name)) AS n, v.version FROM versions v JOIN packages p ON p.id = v.package_id)
SELECT row_id, 'commits' AS target, period, CASE WHEN c.h IS NULL THEN 'missing' ELSE 'late' END AS reason
FROM r LEFT JOIN c ON c.h = r.ch WHERE r.ch <> '' AND (c.h IS NULL OR c.arrived > r.loaded_at)
UNION ALL
SELECT row_id, 'meta', period, 'missing' FROM r WHERE mh <> '' AND NOT EXISTS (SELECT 1 FROM m WHERE m.h = r.mh)
UNION ALL
SELECT row_id, 'versions', period, 'missing' FROM r
WHERE version_key <> '' AND NOT (strpos(version_key, chr(9)) > 0 AND EXISTS (
  SELECT 1 FROM e WHERE e.n = nfc_normalize(lower(split_part(r.version_key, chr(9), 1)))
    AND e.version = substr(r.version_key, strpos(r.version_key, chr(9)) + 1)))
"""

# ---------------------------------------------------------------- 4


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    imports, on = table(spark, base, "commit_systems"), ["commit_seq", "system"]
    keys = imported_only(table(spark, base, "stage_keys"), imports, on)
    contents = imported_only(table(spark, base, "stage_variants"), imports, on)
    key = ["name_key", "version", "attr_path"]
    return snapshot_changes(keys, contents, scope="system", seq="commit_seq", key=key, content="content_hash")


P4_SQL = """
WITH k AS (
  SELECT DISTINCT system, commit_seq, name_key, version, attr_path FROM stage_keys
  WHERE (commit_seq, system) IN (SELECT (commit_seq, system) FROM commit_systems)),
s AS (SELECT system, commit_seq, lag(commit_seq) OVER (PARTITION BY system ORDER BY commit_seq) AS before
  FROM (SELECT DISTINCT system, commit_seq FROM k)),
h AS (SELECT system, commit_seq, name_key, version, attr_path, max(lower(content_hash)) AS h FROM stage_variants GROUP BY ALL),
a AS (SELECT k.*, h.h FROM k LEFT JOIN h USING (system, commit_seq, name_key, version, attr_path)),
n AS (SELECT a.*, s.before FROM a JOIN s USING (system, commit_seq) WHERE s.before IS NOT NULL),
o AS (SELECT a.*, s.commit_seq AS after FROM a JOIN s ON s.system = a.system AND s.before = a.commit_seq)
SELECT coalesce(n.system, o.system) AS system, coalesce(n.commit_seq, o.after) AS commit_seq, coalesce(n.name_key, o.name_key) AS name_key,
  coalesce(n.version, o.version) AS version, coalesce(n.attr_path, o.attr_path) AS attr_path,
  CASE WHEN o.system IS NULL THEN 'added' WHEN n.system IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM n FULL JOIN o ON n.system = o.system AND n.commit_seq = o.after AND n.name_key = o.name_key AND n.version = o.version AND n.attr_path = o.attr_path
WHERE o.system IS NULL OR n.system IS NULL OR n.h IS DISTINCT FROM o.h
"""

# ---------------------------------------------------------------- 5


def key_totals(spark: SparkSession, base: str) -> DataFrame:
    """Variants of each attribute path and of each name key: ``(field, key_value, n)``."""
    variants = table(spark, base, "variants").where(F.col("id").isNotNull()).select("id", "attr_path", "version_id").distinct()
    counted = dense_sums(variants, {"attr_path": "attr_path", "version_id": "version_id"}, sized=table(spark, base, "variants"))
    versions = table(spark, base, "versions").select(F.col("id").cast("string").alias("key_value"), "package_id").distinct()
    packages = table(spark, base, "packages").select(F.col("id").alias("package_id"), name_key(F.col("name")).alias("name")).distinct()
    owned = counted.where(F.col("field") == "version_id").join(versions, "key_value").groupBy("package_id").agg(F.sum("n").alias("n"))
    named = owned.join(packages, "package_id").select("name", F.col("n").alias("rows"))
    named = dense_sums(named, {"name": "name"}, ["rows"], sized=table(spark, base, "packages"))
    named = named.select("field", "key_value", F.col("rows").alias("n"))
    return counted.where(F.col("field") == "attr_path").unionByName(named)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    totals = key_totals(spark, base)
    everything = table(spark, base, "variants").where(F.col("id").isNotNull()).select("id").distinct().count()
    return totals.where((F.col("n") * 100 >= everything) & (F.col("n") > 0)).select("field", "key_value")


#: DuckDB composes but doesn't decompose: the letters that the tables' names have.
_DECOMPOSED = "key_value"
for _letter in "áâäàéêëèíîïìóôöòúûüùñç":
    _DECOMPOSED = f"replace({_DECOMPOSED}, '{_letter}', '{unicodedata.normalize('NFD', _letter)}')"

P5_SQL = """
WITH v AS (SELECT DISTINCT id, attr_path, version_id FROM variants WHERE id IS NOT NULL),
t AS (SELECT count(*) AS t FROM v),
e AS (SELECT DISTINCT id, package_id FROM versions),
p AS (SELECT DISTINCT id, name FROM packages),
a AS (
  SELECT 'attr_path' AS field, attr_path AS key_value, count(*) AS n FROM v WHERE attr_path IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'name', nfc_normalize(lower(p.name)), count(*) FROM v JOIN e ON e.id = v.version_id JOIN p ON p.id = e.package_id WHERE p.name IS NOT NULL GROUP BY ALL)
SELECT field, CASE WHEN field = 'name' THEN {decomposed} ELSE key_value END AS key_value FROM a, t WHERE n * 100 >= t.t
""".replace("{decomposed}", _DECOMPOSED)


def p5_totals(spark: SparkSession, base: str) -> DataFrame:
    """Every attribute path with its variants and how many are broken or insecure."""
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c)
    variants = table(spark, base, "variants").where(F.col("id").isNotNull()).select("id", "attr_path", flag("broken"), flag("insecure")).distinct()
    out = dense_sums(variants, {"attr_path": "attr_path"}, ["broken", "insecure"], sized=table(spark, base, "variants"))
    return out.select(F.col("key_value").alias("attr_path"), F.col("n").alias("variants"), "broken", "insecure")


P5_TOTALS_SQL = """
SELECT attr_path, count(*) AS variants, sum(coalesce(broken, false)::int)::bigint AS broken, sum(coalesce(insecure, false)::int)::bigint AS insecure
FROM (SELECT DISTINCT id, attr_path, coalesce(broken, false) AS broken, coalesce(insecure, false) AS insecure FROM variants WHERE id IS NOT NULL)
WHERE attr_path IS NOT NULL GROUP BY attr_path
"""

# ---------------------------------------------------------------- 6


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return child_items(shred(table(spark, base, "raw_records")))


def p6_packages(spark: SparkSession, base: str) -> DataFrame:
    """The common supertype table of every record's packages, with their structural variants."""
    return subtype_table(shred(table(spark, base, "raw_records")), "packages")


def _p6_subtype(name: str):
    return lambda spark, base: subtype_table(shred(table(spark, base, "raw_records")), name)


#: Texts that are JSON strings of JSON are unwrapped; each package's children are walked leaf by leaf, arrays being left behind.
P6_LEAVES = r"""
WITH RECURSIVE texts AS (
  SELECT DISTINCT raw_id, shape, payload AS j FROM raw_records
  UNION ALL SELECT raw_id, shape, j::json ->> '$' FROM texts WHERE CASE WHEN json_valid(j) THEN json_type(j) = 'VARCHAR' ELSE false END),
docs AS (SELECT raw_id, shape, j::json AS j FROM texts WHERE CASE WHEN json_valid(j) THEN json_type(j) = 'OBJECT' ELSE false END),
evals AS (
  SELECT raw_id, CASE WHEN json_type(j, '$.version') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND json_type(j, '$.packages') = 'OBJECT' THEN j -> '$.packages' ELSE j END AS j
  FROM docs WHERE shape = 'eval'),
entries AS (SELECT raw_id, unnest(json_keys(j)) AS attr_path, unnest(json_extract(j, '$.*')) AS p FROM evals),
packages_ AS (
  SELECT raw_id, 'eval' AS shape, attr_path, p, p -> '$.outputs' AS outputs, CASE WHEN json_type(p, '$.meta') = 'OBJECT' THEN p -> '$.meta.platforms' END AS platforms, NULL::json AS meta_version
  FROM entries WHERE json_type(p) = 'OBJECT' AND json_type(p, '$.outputs') = 'OBJECT'
  UNION ALL SELECT raw_id, 'latest', CASE WHEN json_type(j, '$.attr_path') = 'VARCHAR' THEN j ->> '$.attr_path' END, j, j -> '$.outputs', j -> '$.platforms', j -> '$.meta_version'
  FROM docs WHERE shape = 'latest'),
numbered AS (SELECT *, row_number() OVER () AS package FROM packages_),
children AS (
  SELECT package, 'outputs' AS child, outputs AS j FROM numbered UNION ALL SELECT package, 'platforms', platforms FROM numbered
  UNION ALL SELECT package, 'meta_version', meta_version FROM numbered WHERE shape = 'latest'),
walk AS (
  SELECT package, child, []::int[] AS place, coalesce(j, 'null'::json) AS j FROM children
  UNION ALL SELECT package, child, list_append(place, k::int), j -> ('$[' || k || ']')
  FROM (SELECT *, unnest(range(json_array_length(j)::bigint)) AS k FROM walk WHERE json_type(j) = 'ARRAY')),
kinds AS (
  SELECT *, json_type(j) AS t, CASE WHEN json_type(j) = 'OBJECT' THEN coalesce(json_type(j, '$.name') = 'VARCHAR', false) ELSE false END AS named FROM walk),
states AS (
  SELECT package, child, CASE
    WHEN bool_or(t = 'OBJECT' AND len(place) = 0) THEN CASE WHEN bool_or(named) THEN 'named' ELSE 'object' END
    WHEN bool_or(t = 'VARCHAR' AND len(place) = 0) THEN 'text' WHEN bool_or(t = 'NULL' AND len(place) = 0) THEN 'null' WHEN bool_or(t = 'BOOLEAN' AND len(place) = 0) THEN 'flag'
    WHEN bool_or(t <> 'ARRAY' AND len(place) = 0) THEN 'number' WHEN count(*) = 1 THEN 'empty'
    WHEN bool_and(t = 'VARCHAR') FILTER (len(place) = 1) THEN 'texts' WHEN bool_and(named) FILTER (len(place) = 1) THEN 'objects'
    WHEN bool_and(t = 'VARCHAR' OR t = 'ARRAY') THEN 'nested' ELSE 'mixed' END AS state
  FROM kinds GROUP BY ALL),
leaves AS (
  SELECT raw_id, attr_path, child, CASE WHEN child = 'outputs' AND shape = 'eval' THEN 'outputs_object' WHEN child = 'outputs' AND state = 'named' THEN 'outputs_single'
      WHEN child = 'outputs' THEN 'outputs_array' WHEN state = 'text' THEN child || '_single' WHEN state = 'texts' OR child = 'meta_version' THEN child || '_array' ELSE child || '_nested' END AS "table",
    row_number() OVER (PARTITION BY package, child ORDER BY place)::int - 1 AS ordinal, len(place)::int AS depth,
    CASE WHEN child = 'outputs' THEN j ->> '$.name' WHEN child = 'platforms' THEN regexp_replace(j ->> '$', '^\s+|\s+$', '', 'g') ELSE j ->> '$' END AS item,
    CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.path') = 'VARCHAR' THEN j ->> '$.path' END AS path,
    CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.default') = 'BOOLEAN' THEN (j ->> '$.default')::boolean END AS is_default
  FROM kinds JOIN states USING (package, child) JOIN numbered USING (package)
  WHERE CASE WHEN child = 'outputs' THEN shape = 'latest' AND named ELSE t = 'VARCHAR' END
  UNION ALL SELECT raw_id, attr_path, 'outputs', 'outputs_object', unnest(range(len(json_keys(outputs))::bigint))::int, 1, unnest(json_keys(outputs)),
    unnest(list_transform(json_extract(outputs, '$.*'), lambda v: CASE WHEN json_type(v) = 'VARCHAR' THEN v ->> '$' END)), NULL
  FROM packages_ WHERE shape = 'eval'),
items AS (SELECT DISTINCT * FROM leaves WHERE item <> '')
"""

P6_PACKAGES_SQL = P6_LEAVES + """, said AS (
  SELECT package, max(state) FILTER (child = 'outputs') AS o, max(state) FILTER (child = 'platforms') AS pl, max(state) FILTER (child = 'meta_version') AS m FROM states GROUP BY ALL)
SELECT DISTINCT raw_id, attr_path, shape || ':outputs=' || o || ',platforms=' || pl || coalesce(',meta_version=' || m, '') AS variant,
  CASE WHEN json_type(x.p, '$.version') = 'VARCHAR' THEN x.p ->> '$.version' END AS version, CASE WHEN json_type(x.p, '$.system') = 'VARCHAR' THEN x.p ->> '$.system' END AS system
FROM numbered x JOIN said USING (package)"""


def _p6_table_sql(name: str) -> str:
    more = {"outputs_object": ", path", "outputs_single": ", path, is_default", "outputs_array": ", path, is_default"}.get(name, "")
    return P6_LEAVES + f"SELECT raw_id, attr_path, ordinal, depth, item{more} FROM items WHERE \"table\" = '{name}'"


QUERIES = {
    "p1_found": p1_found,
    "p1_split": p1_split,
    "p3_found": p3_found,
    "p3_split": p3_split,
    "p3_counts": p3_counts,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_totals": p5_totals,
    "p6_found": p6_found,
    "p6_packages": p6_packages,
    **{f"p6_{t}": _p6_subtype(t) for t in CHILD_TABLES},
}
SQL = {
    "p1_found": P1_SQL,
    "p1_split": P1_SQL,
    "p3_found": P3_SQL,
    "p3_split": P3_SQL,
    "p3_counts": f"SELECT target, period, reason, count(*) AS n_rows FROM ({P3_SQL}) GROUP BY ALL",
    "p4_found": P4_SQL,
    "p5_found": P5_SQL,
    "p5_totals": P5_TOTALS_SQL,
    "p6_found": P6_LEAVES + "SELECT DISTINCT raw_id, attr_path, child, item FROM items",
    "p6_packages": P6_PACKAGES_SQL,
    **{f"p6_{t}": _p6_table_sql(t) for t in CHILD_TABLES},
}
