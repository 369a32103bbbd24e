"""A first catalog out of flat records, each a variant with its name, version and commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.functions import version as V
from catalith.functions.names import blank_trimmed, with_name_key
from catalith.functions.paths import top_level
from catalith.operators.decode import decode_latest
from catalith.operators.lookup import first_per_key
from catalith.operators.merge import numbered_commits
from catalith.operators.status import numbered

KEY = ["name_key", "version"]


def seed_records(rows: DataFrame) -> DataFrame:
    """``variant_rows`` taken apart: ``(name, name_key, version, system, attr_path, meta_hash, commit_hash, store_hash, store_name, content_hash)``.

    Records without a name and a version in their key are left out, copies are one; hashes are compared by lower case and without blanks.
    """
    hashed = lambda c: blank_trimmed(F.lower(F.col(c))).alias(c)
    keyed = rows.where(F.instr("version_key", "\t") > 1)
    name, version = F.substring_index("version_key", "\t", 1), F.expr("substring(version_key, instr(version_key, '\t') + 1)")
    parts = keyed.select(name.alias("name"), version.alias("version"), "system", "attr_path", *map(hashed, ("meta_hash", "commit_hash", "content_hash")), "store_hash", "store_name")
    return with_name_key(parts.where(F.col("version") != "").distinct(), "name", "name_key")


def records_of_packages(rows: DataFrame) -> DataFrame:
    """The same of a database's rows ``(name, version, system, attr_path, latest_json)``, whose JSON is a ``latest`` record.

    The row's own name, version, system and path count; contents get the addresses that an evaluation of them would have. Rows without a name, a version or
    complete JSON are left out.
    """
    keys = ("name", "version", "system", "attr_path")
    known = rows.where((F.col("name") != "") & (F.col("version") != "")).select(*keys, F.lit(None).cast("long").alias("raw_id"), F.lit("latest").alias("shape"), F.col("latest_json").alias("payload"))
    made = decode_latest(known, keys).select(*(F.col(f"_{k}").alias(k) for k in keys), "meta_hash", F.lower("commit_hash").alias("commit_hash"), "content_hash", "store_hash", "store_name")
    return with_name_key(made.distinct(), "name", "name_key")


def seeded(records: DataFrame, commits: DataFrame) -> dict[str, DataFrame]:
    """The tables of a catalog that holds just ``records`` (of ``seed_records``), at ``commits (hash, committed_at)``.

    Commits are numbered by their time. A package is spelled as most of its records do, the smallest spelling of equals; of
    several records of one variant the one with the newest known commit counts, then the greatest content. Each variant has a seeded point range
    at its commit; one whose commit is unknown has none. Empty tables give empty ones.
    """
    timeline = numbered_commits(commits).withColumn("hash", F.lower("hash"))
    named = records.groupBy("name_key", "name").count().groupBy("name_key").agg(F.min(F.struct((-F.col("count")).alias("n"), "name")).alias("_b"))
    packages = numbered(named.select("name_key", F.col("_b.name").alias("name")), ["name", "name_key"], "id")
    made = records.select(*KEY).distinct().join(packages.select(F.col("id").alias("package_id"), "name_key"), "name_key")
    s = V.semver(F.col("version"))
    versions = numbered(made, ["package_id", "version"], "id").withColumn("_s", s)
    pre = F.nullif(F.col("_s.pre"), F.lit("")).alias("semver_pre")
    versions = versions.select("id", "package_id", *KEY, V.sort_key(F.col("version")).alias("sort_key"), V.is_prerelease(F.col("version")).alias("prerelease"), *(F.col(f"_s.{x}").alias(f"semver_{x}") for x in ("major", "minor", "patch")), pre)
    dated = records.join(timeline.withColumnRenamed("hash", "commit_hash"), "commit_hash", "left")
    one = first_per_key(dated, [*KEY, "system", "attr_path"], [F.desc_nulls_last("seq"), F.desc_nulls_last("content_hash"), F.asc("name")])
    one = one.join(versions.select(F.col("id").alias("version_id"), *KEY), KEY)
    variants = numbered(one.select("version_id", "system", "attr_path", F.col("seq").alias("commit_seq"), "meta_hash", "store_hash", "store_name", "content_hash"), ["version_id", "system", "attr_path"], "id")
    points = variants.where(F.col("commit_seq").isNotNull()).select(F.col("id").alias("variant_id"), F.col("commit_seq").alias("first_seq"), F.col("commit_seq").alias("last_seq"), F.lit(True).alias("seeded"), F.lit(None).cast("int").alias("backfill_last_seq"))
    terms = records.select("name_key", "attr_path").distinct().join(packages, "name_key").select(F.col("id").alias("package_id"), "name", "attr_path", top_level(F.col("attr_path")).alias("top_level_attr"))
    return {"commits": timeline, "packages": packages.select("id", "name"), "versions": versions.drop("name_key"), "variants": variants, "variant_ranges": points, "search_terms": terms}


def seed_report(records: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``(label, got, want)``: what the seeded tables hold against what the records say."""
    count = F.count(F.lit(1)).alias("n")
    wanted = {
        "packages": records.agg(F.count_distinct("name_key")),
        "versions": records.select(*KEY).distinct().agg(count),
        "variants": records.select(*KEY, "system", "attr_path").distinct().agg(count),
        "search_terms": records.select("name_key", "attr_path").distinct().agg(count),
        "variant_ranges": records.select(*KEY, "system", "attr_path", "commit_hash").join(tables["commits"].withColumnRenamed("hash", "commit_hash"), "commit_hash", "left_semi").select(*KEY, "system", "attr_path").distinct().agg(count),
    }
    parts = []
    for label, df in wanted.items():
        got, want = tables[label].agg(count).select(F.lit(label).alias("label"), F.col("n").alias("got")), df.toDF("want").select(F.lit(label).alias("label"), "want")
        parts.append(got.join(F.broadcast(want), "label"))  # one row
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
