"""Continuous periods and gaps against a set-based version."""

import functools
import random

import pytest

from catalith.operators import intervals
from catalith.operators.intervals import OPEN_END, continuous_periods

SCHEMA = "e int, s int, t int, e_extra string, piece string"


def brute(ranges, points=None, scope_of=None):
    out = []
    for e in {r[0] for r in ranges if r[0] is not None}:
        own = sorted((s, OPEN_END if t is None else t) for x, s, t in ranges if x == e and s is not None and (t is None or t >= s))
        known = None if points is None else sorted({p for c, p in points if p is not None and c == scope_of.get(e)})
        merged = []
        for s, t in own:
            between = merged and (s - merged[-1][1] > 1 if known is None else any(merged[-1][1] < p < s for p in known))
            if merged and (s <= merged[-1][1] or not between):
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        for k, (s, t) in enumerate(merged):
            if k:
                out.append((e, "gap", merged[k - 1][1] + 1, s - 1))
            out.append((e, "period", s, t))
    return sorted(out, key=str)


def frame(spark, ranges):
    return spark.createDataFrame([(*r, "x", "clash") for r in ranges], SCHEMA)


@pytest.mark.parametrize("starts", [1_000_000, 7])
def test_against_brute_force(spark, rows, starts):
    rng = random.Random(starts)
    ranges = [(rng.randrange(6), s := rng.randrange(120), rng.choice([None] + [s + rng.randrange(-2, 9) for _ in range(30)])) for _ in range(300)]
    ranges += ranges[:50] + [(None, 1, 2), (1, None, 5), (9, 5, 4)]
    assert rows(continuous_periods(frame(spark, ranges), "e", "s", "t", entity_starts=starts)) == brute(ranges)
    points = [(c, rng.randrange(130)) for c in "ab" for _ in range(25)] + [("a", None), (None, 3)]
    scopes = {k: "ab"[k % 2] for k in range(5)}  # one entity has none
    got = continuous_periods(
        frame(spark, ranges), "e", "s", "t", entity_starts=starts,
        scope_of=spark.createDataFrame([*scopes.items(), (0, "a")], "e int, scope string"), points=spark.createDataFrame(points, "scope string, point int"),
    )
    assert rows(got) == brute(ranges, points, scopes)


@pytest.mark.parametrize("most,spread", [(500_000, 1), (7, 1), (40, 10_000_019)])
def test_timeline_of_any_span(spark, rows, monkeypatch, most, spread):
    """Places like seconds of an epoch: the table follows the limit, not the span."""
    rng = random.Random(most)
    points = [(c, rng.randrange(90) * spread) for c in "ab" for _ in range(30)]
    ranges = [(rng.randrange(5), s := rng.randrange(-3, 95) * spread + rng.randrange(-1, 2), s + rng.randrange(6) * spread) for _ in range(120)]
    scopes = {k: "ab"[k % 2] for k in range(4)}
    monkeypatch.setattr(intervals, "timeline_of", functools.partial(intervals.timeline_of, rows=most))
    timeline = intervals.timeline_of(spark.createDataFrame(points, "c string, p int"), "c", "p")
    assert timeline.table.count() <= most + 4 or timeline.width == 1
    got = continuous_periods(
        frame(spark, ranges), "e", "s", "t", scope_of=spark.createDataFrame([*scopes.items()], "e int, scope string"), points=spark.createDataFrame(points, "scope string, point int"),
    )
    assert rows(got) == brute(ranges, points, scopes)


def test_empty(spark, rows):
    assert rows(continuous_periods(frame(spark, []), "e", "s", "t")) == []
    points = spark.createDataFrame([], "scope string, point int")
    scopes = spark.createDataFrame([], "e int, scope string")
    assert rows(continuous_periods(frame(spark, [(1, 1, 2), (1, 9, 9)]), "e", "s", "t", scope_of=scopes, points=points)) == [(1, "period", 1, 9)]
