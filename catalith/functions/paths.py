"""Attribute paths, store paths, systems and references as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attribute paths that go by one name, first match first.
CANONICAL_NAMES = [
    ("apache", r"^apacheHttpd$"),
    ("apacheKafka", r"^apacheKafka[0-9_]*$"),
    ("gcc", r"^gcc[0-9]*$"),
    ("go", r"^go(_[0-9]_[0-9]{1,2})?$"),
    ("jdk", r"^jdk[0-9]*$"),
    ("jdk-headless", r"^jdk[0-9]*_headless$"),
    ("jre", r"^jre[0-9]*$"),
    ("jre-headless", r"^jre[0-9]*_headless$"),
    ("mariadb", r"^mariadb(_[0-9]+)?$"),
    ("mono", r"^mono[0-9]*$"),
    ("nix", r"^nixVersions\..+$"),
    ("nodejs", r"^nodejs(-|_)[0-9]*(_x)?$"),
    ("nodejs-slim", r"^nodejs-slim(-|_)[0-9]*(_x)?$"),
    ("php", r"^php[0-9]*$"),
    ("python", r"^python[0-9]*$"),
    ("python-full", r"^python[0-9]*Full$"),
    ("python-minimal", r"^python[0-9]*Minimal$"),
    ("ruby", r"^ruby[0-9_]*$"),
    ("tomcat", r"^tomcat[0-9]*$"),
    ("zulu", r"^zulu[0-9]*$"),
]
# Systems with their architecture and operating system.
SYSTEMS = {
    "aarch64-darwin": ("arm64", "macOS"),
    "aarch64-linux": ("arm64", "Linux"),
    "x86_64-darwin": ("x86-64", "macOS"),
    "x86_64-linux": ("x86-64", "Linux"),
}


def canonical_name(attr_path: Column, rules: list[tuple[str, str]] = CANONICAL_NAMES) -> Column:
    """The name of the first rule that matches, else the path itself."""
    out = F
    for name, pattern in rules:
        out = out.when(attr_path.rlike(pattern), F.lit(name))
    return out.otherwise(attr_path) if rules else attr_path


def split_store_path(path: Column, prefix: str = "/nix/store/") -> Column:
    """``struct(hash, name, version)`` of a store path, with or without its prefix.

    The hash is the first 32 characters; after the one that follows, the name ends at the first dash (not at its
    start) whose next character is no letter. What is missing is "".
    """
    bare = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)
    long = F.length(bare) >= 32
    rest = F.when(F.length(bare) >= 34, F.substring(bare, 34, 1 << 30)).otherwise("")
    pattern = r"(?s)^(.+?)-(\P{L}.*)$"
    parted = rest.rlike(pattern)
    return F.when(
        path.isNotNull(),
        F.struct(
            F.when(long, F.substring(bare, 1, 32)).otherwise("").alias("hash"),
            F.when(parted, F.regexp_extract(rest, pattern, 1)).otherwise(rest).alias("name"),
            F.when(parted, F.regexp_extract(rest, pattern, 2)).otherwise("").alias("version"),
        ),
    )


def arch_os(system: Column) -> Column:
    """``struct(arch, os)``, both "" for a system that isn't known."""
    pick = lambda k: F.coalesce(F.create_map(*(F.lit(x) for s, v in SYSTEMS.items() for x in (s, v[k])))[system], F.lit(""))
    return F.struct(pick(0).alias("arch"), pick(1).alias("os"))


def supported(system: Column) -> Column:
    return system.isin(list(SYSTEMS))


def top_level(attr_path: Column) -> Column:
    """The path itself if it has no dot, else null."""
    return F.when(~attr_path.contains("."), attr_path)


def split_reference(ref: Column) -> Column:
    """``struct(name, version)`` of ``name@version``; a version only after an @ that isn't the first character."""
    at = F.instr(ref, "@")
    return F.struct(F.when(at > 1, F.substring_index(ref, "@", 1)).otherwise(ref).alias("name"), F.when(at > 1, ref.substr(at + 1, F.length(ref))).alias("version"))


def archive_key(system: Column, moment: Column, commit: Column) -> Column:
    return F.concat(system, F.lit("/"), F.unix_timestamp(moment).cast("string"), F.lit("-"), commit, F.lit(".json.gz"))


def parse_archive_name(path: Column) -> Column:
    """``struct(kind, system, commit)`` of an evaluation's file name, nulls if it is none."""
    pattern = r"(eval|hidden)-([^/]+)-([0-9a-f]{7,40})\.json\.gz$"
    part = lambda k: F.when(path.rlike(pattern), F.regexp_extract(path, pattern, k))
    return F.struct(part(1).alias("kind"), part(2).alias("system"), part(3).alias("commit"))


def listed_prefixes(xml: Column) -> Column:
    """The prefixes that a page of an object listing names."""
    return F.regexp_extract_all(xml, F.lit("<Prefix>([^<]*)</Prefix>"), F.lit(1))


def xml_tag(xml: Column, tag: str) -> Column:
    pattern = f"<{tag}>([^<]*)</{tag}>"
    return F.when(xml.rlike(pattern), F.regexp_extract(xml, pattern, 1))
