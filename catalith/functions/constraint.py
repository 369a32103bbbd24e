"""Version constraints: parsed once on the driver, applied as a Column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith.functions.version import precedence

_MAX_SAFE = 9007199254740991
# The forms of a comparator.
_COMPARATOR = re.compile(r"(>=|<=|>|<|=|\^|~)?\s*(.*)", re.S)
_PARTIAL = re.compile(r"v?([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(?:-([0-9A-Za-z.-]+))?")


@dataclass(frozen=True)
class Bound:
    numbers: tuple[int, int, int]
    pre: str = ""
    inclusive: bool = True

    @property
    def column(self) -> Column:
        return precedence(*(F.lit(n) for n in self.numbers), F.lit(self.pre))


@dataclass(frozen=True)
class Constraint:
    low: Bound | None
    high: Bound | None
    exact: bool


def parse_constraint(text: str) -> Constraint | None:
    """A range of semantic versions, or None if the text is no such range.

    Comparators are joined by blanks or commas, a later bound replacing an earlier one. ``3`` and ``3.1`` mean every
    version within, ``^`` and ``~`` what stays compatible. A prerelease suffix needs all three numbers.
    """
    low = high = None
    exact = False
    parts = [p for p in re.split(r"[\s,]+", text.strip()) if p]
    if not parts or parts == ["latest"]:
        return None
    for part in parts:
        op, rest = _COMPARATOR.fullmatch(part).groups()
        m = _PARTIAL.fullmatch(rest)
        if not m:
            return None
        given = [int(x) for x in m.groups()[:3] if x is not None]
        pre = m[4] or ""
        if max(given) > _MAX_SAFE or (pre and len(given) < 3):
            return None
        at = (*given, 0, 0)[:3]
        major, minor = at[:2]
        next_major, next_minor = Bound((major + 1, 0, 0), inclusive=False), Bound((major, minor + 1, 0), inclusive=False)
        if op in (">", ">="):
            low = Bound(at, pre, op == ">=")
        elif op in ("<", "<="):
            high = Bound(at, pre, op == "<=")
        elif op == "^":
            low, high = Bound(at, pre), next_minor if major == 0 and len(given) > 1 else next_major
        elif op == "~":
            low, high = Bound(at, pre), next_minor if len(given) > 1 else next_major
        elif len(given) == 3:
            low = high = Bound(at, pre)
            exact = True
        else:
            low, high = Bound(at, pre), next_minor if len(given) == 2 else next_major
    return Constraint(low, high, exact)


def satisfies(c: Constraint, major: Column, minor: Column, patch: Column, pre: Column) -> Column:
    """Whether a semantic version meets the constraint; null major: no.

    Prereleases only meet an exact constraint or one with a bound that names a prerelease. The bounds on ``major`` alone
    come first, so that a scan can push them down.
    """
    numbers = F.struct(*(F.coalesce(x, F.lit(0)).cast("long").alias(k) for k, x in zip("abc", (major, minor, patch))))
    final = F.coalesce(pre, F.lit("")) == ""

    def against(bound: Bound, below: bool) -> Column:
        """On the bound's inner side, or on it if it is included."""
        if bound.pre:
            own, limit = precedence(major, minor, patch, pre), bound.column
            return (own < limit if below else own > limit) | (F.lit(bound.inclusive) & (own == limit))
        limit = F.struct(*(F.lit(n).cast("long").alias(k) for k, n in zip("abc", bound.numbers)))
        on = final & F.lit(bound.inclusive)
        if below:  # prereleases of the bound come before it
            return (numbers < limit) | ((numbers == limit) & (on | ~final))
        return (numbers > limit) | ((numbers == limit) & on)

    out = major.isNotNull()
    if c.low:
        out = out & (major >= c.low.numbers[0]) & against(c.low, below=False)
    if c.high:
        out = out & (major <= c.high.numbers[0]) & against(c.high, below=True)
    if not c.exact and not any(b and b.pre for b in (c.low, c.high)):
        out = out & (F.coalesce(pre, F.lit("")) == "")
    return F.coalesce(out, F.lit(False))


#: Columns of a request table that hold a parsed constraint.
CONSTRAINT_COLUMNS = ",".join(f"{s}_{k}" for s in ("low", "high") for k in ("major long", "minor long", "patch long", "pre string", "in boolean")) + ",ranged boolean,prereleases boolean"


def constraint_row(c: Constraint | None) -> tuple:
    """A constraint as values of ``CONSTRAINT_COLUMNS``; None is no range."""
    out: list = []
    for b in (c.low, c.high) if c else (None, None):
        out += [None] * 5 if b is None else [*b.numbers, b.pre, b.inclusive]
    return (*out, c is not None, c is not None and (c.exact or any(b and b.pre for b in (c.low, c.high))))


def satisfies_row(major: Column, minor: Column, patch: Column, pre: Column) -> Column:
    """``satisfies`` with the constraint in the row's own ``CONSTRAINT_COLUMNS``."""
    own = precedence(major, minor, patch, pre)
    bound = lambda s: precedence(*(F.col(f"{s}_{k}") for k in ("major", "minor", "patch", "pre")))
    final = F.coalesce(pre, F.lit("")) == ""
    above = F.col("low_major").isNull() | (own > bound("low")) | (F.col("low_in") & (own == bound("low")))
    below = F.col("high_major").isNull() | (own < bound("high")) | (F.col("high_in") & (own == bound("high")))
    return F.coalesce(F.col("ranged") & major.isNotNull() & (final | F.col("prereleases")) & above & below, F.lit(False))


def prefix_with_boundary(version: Column, text: str | Column) -> Column:
    """The version itself, or one that goes on after it with a dot or a dash."""
    text = F.lit(text) if isinstance(text, str) else text
    return (version == text) | version.startswith(F.concat(text, F.lit("."))) | version.startswith(F.concat(text, F.lit("-")))
