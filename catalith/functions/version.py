"""Version strings as Columns: components, sort keys, prerelease marks and semantic versions.

Everything stays inside whole-stage code generation: regular expressions and array functions only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that make a component a prerelease, and the class bytes of the sort key.
PRERELEASE_TAGS = ["a", "b", "c", "rc", "alpha", "beta", "pre", "preview"]
PRETAG, END, ALPHA, NUMERIC = "01", "02", "03", "04"

#: A run of digits, or a run of neither digits nor separators (``. - _`` and code points below 5).
_COMPONENT = r"([0-9]+|[^0-9._\-\x00-\x04]+)"
_MAX_SAFE = 9007199254740991

# Fixed value: the PEP 440 pattern with numbered groups; group 3 is the prerelease part.
_PEP440 = (
    r"^[\t\n\f\r ]*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)"
    r"([-_.]?(?:a|b|c|rc|alpha|beta|pre|preview)[-_.]?(?:[0-9]+)?)?"
    r"(?:(?:-[0-9]+)|(?:[-_.]?(?:post|rev|r)[-_.]?(?:[0-9]+)?))?"
    r"(?:[-_.]?dev[-_.]?(?:[0-9]+)?)?(?:\+[a-z0-9]+(?:[-_.][a-z0-9]+)*)?[\t\n\f\r ]*$"
)
_IDENTIFIER = r"(?:0|[1-9][0-9]*|[0-9]*[a-zA-Z-][0-9a-zA-Z-]*)"
_BUILD = r"(?:\+[0-9a-zA-Z-]+(?:\.[0-9a-zA-Z-]+)*)?"
_NUMBER = r"(0|[1-9][0-9]*)"
# Strict semantic versions, and the looser v-prefixed form where minor and patch may be missing.
_SEMVER = rf"^v?{_NUMBER}\.{_NUMBER}\.{_NUMBER}(?:-({_IDENTIFIER}(?:\.{_IDENTIFIER})*))?{_BUILD}$"
_LOOSE = rf"^v{_NUMBER}(?:\.{_NUMBER}(?:\.{_NUMBER})?)?(?:-({_IDENTIFIER}(?:\.{_IDENTIFIER})*))?{_BUILD}$"


def components(version: Column) -> Column:
    """Array of the components in order; numbers without leading zeros, prerelease tags in lower case."""
    bare = F.regexp_replace(version, r"^v(?=[0-9])", "")
    return F.transform(F.regexp_extract_all(bare, F.lit(_COMPONENT), F.lit(1)), _component)


def _component(c: Column) -> Column:
    low = F.lower(c)
    return F.when(c.rlike("^[0-9]"), F.regexp_replace(c, r"^0+(?=.)", "")).when(low.isin(PRERELEASE_TAGS), low).otherwise(c)


def _key_part(c: Column) -> Column:
    byte = lambda n: F.lpad(F.hex(n), 2, "0")
    number = F.concat(F.lit(NUMERIC), byte(F.least(F.length(c), F.lit(255)).cast("long")), F.hex(F.encode(c, "UTF-8")))
    text = F.hex(F.encode(c, "UTF-8"))
    return F.when(c.rlike("^[0-9]"), number).when(c.isin(PRERELEASE_TAGS), F.concat(F.lit(PRETAG), text)).otherwise(F.concat(F.lit(ALPHA), text))


def sort_key(version: Column) -> Column:
    """Bytes whose unsigned order is the order of versions; null for null.

    Each component is a class byte and its text, numbers with a byte of their length (at most 255) first; the end ranks
    between prerelease tags and other text, so ``1.0-rc1 < 1.0 < 1.0q < 1.0.1``.
    """
    parts = F.transform(components(version), _key_part)
    return F.unhex(F.concat(F.array_join(parts, ""), F.lit(END)))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    x, y = sort_key(a), sort_key(b)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def prerelease_part(version: Column) -> Column:
    """What marks a version as a prerelease, "" if nothing does."""
    loose = F.regexp_extract(version, _LOOSE, 4)
    pep = F.regexp_replace(F.regexp_extract(F.lower(version), _PEP440, 3), r"^[-_.]+", "")
    out = F.when(version.rlike(_LOOSE), F.when(loose != "", F.concat(F.lit("-"), loose)).otherwise("")).when(pep != "", pep)
    for tag in ("alpha", "beta", "pre", "preview", "rc"):
        out = out.when(version.endswith(tag), F.lit(tag))
    return out.otherwise(F.when(version.isNotNull(), ""))


def is_prerelease(version: Column) -> Column:
    return prerelease_part(version) != ""


def semver(version: Column) -> Column:
    """``struct(major, minor, patch, pre)`` of a strict semantic version (a leading v allowed), else null; ``pre`` is "" if there is none."""
    part = lambda k: F.regexp_extract(version, _SEMVER, k).try_cast("bigint")
    nums = [part(k) for k in (1, 2, 3)]
    ok = version.rlike(_SEMVER)
    for n in nums:
        ok = ok & n.isNotNull() & (n <= _MAX_SAFE)
    pre = F.regexp_extract(version, _SEMVER, 4)
    return F.when(ok, F.struct(*(n.alias(k) for n, k in zip(nums, ("major", "minor", "patch"))), pre.alias("pre")))


def prerelease_rank(pre: Column) -> Column:
    """An array that orders prerelease identifiers: numbers before text, shorter first."""
    return F.transform(
        F.split(pre, r"\."),
        lambda x: F.struct(
            F.when(x.rlike("^[0-9]+$"), 0).otherwise(1).alias("text"),
            F.coalesce(F.when(x.rlike("^[0-9]+$"), x.try_cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("number"),
            F.when(x.rlike("^[0-9]+$"), "").otherwise(x).alias("name"),
        ),
    )


def precedence(major: Column, minor: Column, patch: Column, pre: Column) -> Column:
    """A struct that orders semantic versions by precedence."""
    pre = F.coalesce(pre, F.lit(""))
    return F.struct(major.cast("long").alias("a"), F.coalesce(minor, F.lit(0)).cast("long").alias("b"), F.coalesce(patch, F.lit(0)).cast("long").alias("c"), (pre == "").alias("final"), prerelease_rank(pre).alias("pre"))
