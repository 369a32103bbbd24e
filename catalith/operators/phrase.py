"""Ranked search of names and attribute paths by a phrase."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.names import PHRASE_ALIASES
from catalith.functions.trigram import ALIKE, similarity_of, trigrams, trigrams_of
from catalith.operators.lookup import ROWS, first_per_key, latest_versions, newest_releases, release_order, result_rows
from catalith.operators.status import numbered
from catalith.session import materialised
from catalith.sources.catalog import Catalog, given, small

#: Packages that a phrase finds at most, unless the caller lifts it.
HITS = 50


def parse_releases(value: str | None) -> int | str | None:
    """How many releases a request asks for: None for none, ``all``, or a count; a count beyond exact integers is all, other text an error."""
    if value is None or value == "all":
        return value
    if not re.fullmatch("[1-9][0-9]*", value):
        raise ValueError(f"releases must be a positive integer or all: {value!r}")
    return int(value) if int(value) <= 9007199254740991 else "all"


def _scored(terms: DataFrame, low: Column, own: Column, aliases: Column, *more: str) -> DataFrame:
    """``(*more, package_id, name, rank)`` of the terms that match a phrase (``low`` in lower case, ``own`` trigrams) by prefix, alias or likeness.

    Trigrams, then similarities, then the rank, each in a projection of its own, so that nothing is computed twice.
    """
    same = F.col("name") == F.col("attr_path")
    kept = [*more, "package_id", "name", "top_level_attr", "_low", "_own", "_aliases"]
    terms = terms.withColumns({"_low": low, "_own": own, "_aliases": aliases})
    grams = terms.select(*kept, F.lower("name").alias("_n"), F.lower("attr_path").alias("_p"), trigrams(F.col("name")).alias("_gn"), F.when(~same, trigrams(F.col("attr_path"))).alias("_gp"))
    by_path = F.when(F.col("_gp").isNotNull(), similarity_of(F.col("_gp"), F.col("_own")))
    alike = grams.select(*kept, "_n", "_p", similarity_of(F.col("_gn"), F.col("_own")).alias("_sn"), by_path.alias("_sp"))
    alike = alike.withColumn("_s", F.greatest("_sn", "_sp"))
    name, path, low = F.col("_n"), F.col("_p"), F.col("_low")
    alias = F.array_contains("_aliases", name) | F.array_contains("_aliases", path)
    tier = F.when(alias, 2000).when(name == low, 1000).when(path == low, 900).when(name.startswith(low), 800).when(path.startswith(low), 700).otherwise(0)
    ranked = alike.select(*more, "package_id", "name", "_s", tier.alias("_tier"), F.when(F.col("top_level_attr").isNotNull(), 25).otherwise(0).alias("_top"))
    return ranked.where((F.col("_tier") > 0) | (F.col("_s") >= ALIKE)).select(*more, "package_id", "name", (F.col("_tier") + 100 * F.col("_s") + F.col("_top")).alias("rank"))


def rank_phrase(c: Catalog, phrase: str, hits: int | None = HITS, aliases: dict[str, list[str]] = PHRASE_ALIASES) -> DataFrame:
    """``(ord, package_id, name, rank)`` of the packages a phrase finds, best first, ties by name and id.

    Alias 2000, exact name 1000, exact path 900, name prefix 800, path prefix 700, else 0; plus 100 times the trigram similarity, plus 25
    for a path without a dot; a package has the best of its paths. Similar terms count only when fewer than
    ``hits`` packages match by prefix. One scan of the terms scores both tiers, as the lower tier never reaches the upper's scores; names and
    paths that share no trigram with the phrase, begin otherwise and are no alias are left out before they are scored. ``hits=None`` lists all.
    """
    known = [a.lower() for a in aliases.get(phrase.lower(), [])] if any(ch.isalnum() for ch in phrase) else []
    texts = lambda values: F.array(*(F.lit(t) for t in values)).cast("array<string>")
    low, own = phrase.lower(), trigrams_of(phrase)
    # A shared trigram lies within a word: its text without the padding occurs in the name or path.
    cores = "|".join(dict.fromkeys(re.escape(g.strip()) for g in own))
    begins = lambda c: F.lower(c).startswith(low) | F.lower(c).isin(known)
    may = lambda c: begins(c) | F.lower(c).rlike(cores) if cores else begins(c)
    scored = _scored(c.search_terms.where(may("name") | may("attr_path")), F.lit(low), texts(own), texts(known))
    best = scored.groupBy("package_id", "name").agg(F.max("rank").alias("rank"))
    if hits is None:
        listed = numbered(best.withColumn("_down", -F.col("rank")), ["_down", "name", "package_id"], "ord")
        return listed.select(F.col("ord").cast("int").alias("ord"), "package_id", "name", "rank")
    top = best.orderBy(F.desc("rank"), "name", "package_id").limit(hits)
    ordered = top.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("rank"), "name", "package_id"))).alias("a"))  # at most ``hits`` rows
    return ordered.select(F.posexplode("a").alias("ord", "h")).select((F.col("ord") + 1).alias("ord"), "h.package_id", "h.name", (-F.col("h.rank")).alias("rank"))


def rank_phrases(c: Catalog, phrases: DataFrame, hits: int | None = HITS, aliases: dict[str, list[str]] = PHRASE_ALIASES) -> DataFrame:
    """``(phrase, ord, package_id, name, rank)`` of ``phrases (phrase)``: what ``rank_phrase`` gives for each, all at once.

    Phrases meet the distinct names and paths by trigram postings, by each prefix and by alias, so that only what may match is
    scored. Copies of a phrase are one; null phrases find nothing.
    """
    asked = phrases.select("phrase").where(F.col("phrase").isNotNull()).distinct().withColumns({"_low": F.lower("phrase"), "_own": trigrams(F.col("phrase"))})
    listed = [(k, [a.lower() for a in v]) for k, v in aliases.items()]
    known = F.create_map(*(x for k, v in listed for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))[F.col("_low")] if listed else F.lit(None)
    none = F.array().cast("array<string>")
    asked = asked.withColumn("_aliases", F.coalesce(F.when(F.col("phrase").rlike(r"[\p{L}\p{N}]"), known), none))
    terms = c.search_terms.withColumn("_t", F.explode(F.array_distinct(F.array_compact(F.array(F.lower("name"), F.lower("attr_path"))))))
    # All postings of a text are in one of many small tasks, so that what it shares with the phrases is counted without a shuffle of the pairs.
    texts = terms.select("_t").distinct().repartition(8 * int(c.spark.conf.get("spark.sql.shuffle.partitions")), "_t")
    postings = texts.withColumn("_g", trigrams(F.col("_t"))).select("_t", F.size("_g").alias("_n"), F.explode("_g").alias("_gram"))
    own = small(asked.select("phrase", F.size("_own").alias("_m"), F.explode("_own").alias("_gram")))
    shared = postings.join(own, "_gram").groupBy("phrase", "_m", "_t", "_n").agg(F.count(F.lit(1)).alias("_k"))
    alike = shared.where(F.col("_k") / (F.col("_m") + F.col("_n") - F.col("_k")) >= ALIKE).select("phrase", "_t")
    prefix = F.transform(F.sequence(F.lit(0), F.length("_t")), lambda i: F.substring(F.col("_t"), F.lit(1), i))
    begun = texts.select("_t", F.explode(prefix).alias("_low")).join(asked.select("phrase", "_low"), "_low").select("phrase", "_t")
    named = asked.select("phrase", F.explode("_aliases").alias("_t"))
    pairs = alike.unionByName(begun).unionByName(named).distinct()
    found = pairs.join(terms, "_t").drop("_t").distinct().join(asked, "phrase")
    scored = _scored(found, F.col("_low"), F.col("_own"), F.col("_aliases"), "phrase")
    best = scored.groupBy("phrase", "package_id", "name").agg(F.max("rank").alias("rank"))
    w = Window.partitionBy("phrase").orderBy(F.desc("rank"), "name", "package_id")
    placed = best.withColumn("ord", F.row_number().over(w))
    return (placed if hits is None else placed.where(F.col("ord") <= hits)).select("phrase", "ord", "package_id", "name", "rank")


def search_phrase(c: Catalog, phrase: str, latest_only: bool = True, releases: str | None = None, hits: int | None = HITS, rows: int | None = ROWS) -> DataFrame:
    """Rows of the packages a phrase finds, in their order: one at its latest version each, or one for each version.

    Of a version's rows the first by system and path is taken; ``releases`` (see ``parse_releases``) adds the newest releases with their systems.
    ``hits`` bounds the packages, ``rows`` the versions' rows; None lifts either. Only what the hits need is read on.
    """
    asked = parse_releases(None if releases is None else str(releases))
    found = rank_phrase(c, phrase, hits).select("ord", "package_id")
    found = materialised(found)  # the ranking is needed more than once
    found = found if hits is None else given(found, hits)
    packages = found.select("package_id")
    if latest_only:
        chosen = latest_versions(c, among=packages).join(found, "package_id").select("ord", "version_id")
    else:
        chosen = c.versions("package_id", "version_id", among=packages).join(found, "package_id").select("ord", "version_id")
    out = result_rows(c, c.shown_variants(among=chosen.select("version_id"))).join(chosen, "version_id")
    if not latest_only:
        out = first_per_key(out, ["ord", "sort_key", "version"], [F.asc("system"), F.asc("attr_path")]).orderBy("ord", *release_order(), "system", "attr_path")
        return out if rows is None else out.limit(rows)
    systems = c.variants("version_id", "system", among=chosen.select("version_id")).groupBy("version_id").agg(F.array_sort(F.collect_set("system")).alias("version_systems"))
    out = first_per_key(out, ["ord"], [F.asc("system"), F.asc("attr_path")]).join(systems, "version_id")
    if asked is not None:
        listed = newest_releases(c, None if asked == "all" else asked, among=packages)
        one = F.struct("place", "version", "systems")
        listed = listed.groupBy("package_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["version"].alias("version"), F.split(x["systems"], ",").alias("systems")))).alias("releases"))
        out = out.join(listed, "package_id", "left")
    return out.orderBy("ord")
