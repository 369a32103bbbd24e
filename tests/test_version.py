"""Version functions: fixed vectors, and order against a comparator written out in Python."""

import functools
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalith.functions import version as V
from catalith.functions.constraint import CONSTRAINT_COLUMNS, constraint_row, parse_constraint, prefix_with_boundary, satisfies, satisfies_row

TAGS = {"a", "b", "c", "rc", "alpha", "beta", "pre", "preview"}


def parts(v):
    v = re.sub(r"^v(?=[0-9])", "", v)
    for run in re.findall(r"[0-9]+|[^0-9._\-\x00-\x04]+", v):
        if run[0] in "0123456789":
            digits = run.lstrip("0") or "0"
            yield 3, (min(len(digits), 255), digits.encode())
        elif run.lower() in TAGS:
            yield 0, (0, run.lower().encode())
        else:
            yield 2, (0, run.encode())


def compare(a, b):
    x, y = [*parts(a), (1, (0, b""))], [*parts(b), (1, (0, b""))]
    return (x > y) - (x < y)


def test_known_orders(spark):
    ascending = ["1.0-alpha", "1.0-b2", "1.0rc1", "1.0", "1.0q", "1.0.1", "1.2", "1.10", "v2", "3.0-pre1", "3.0", "2024-01-05"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(ascending)], "k int, v string")
    assert [r.k for r in df.orderBy(V.sort_key(F.col("v"))).collect()] == list(range(len(ascending)))
    same = spark.createDataFrame([("1", "01"), ("v1", "1"), ("1.0", "1-0"), ("1_2", "1.2"), (None, "1")], "a string, b string")
    assert [r[0] for r in same.select(V.compare_versions(F.col("a"), F.col("b"))).collect()] == [0, 0, 0, 0, None]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.-_vabrcpreq\x03é中", max_size=12), min_size=2, max_size=60))
def test_sort_key_orders_as_the_comparator(spark, versions):
    df = spark.createDataFrame([(v,) for v in versions], "v string")
    keys = {r.v: bytes(r.k) for r in df.select("v", V.sort_key(F.col("v")).alias("k")).collect()}
    by_key = sorted(versions, key=lambda v: keys[v])
    for a, b in zip(by_key, by_key[1:]):
        assert compare(a, b) <= 0 and (compare(a, b) == 0) == (keys[a] == keys[b])
    assert sorted(versions, key=functools.cmp_to_key(compare)) == sorted(versions, key=lambda v: keys[v]) or len(set(keys.values())) < len(set(versions))


def test_long_numbers(spark):
    long = "9" * 300
    df = spark.createDataFrame([("1." + long,), ("1." + "8" * 300,), ("1.9",)], "v string")
    assert [r.v[:4] for r in df.orderBy(V.sort_key(F.col("v"))).collect()] == ["1.9", "1.88", "1.99"]


def test_prerelease_and_semver(spark):
    cases = {
        "v1.0.0-rc1": "-rc1", "1.0.0rc1": "rc1", "2.0a": "a", "1.0-beta.2": "beta.2", "3.9.0b6": "b6", "1.0": "", "v1-pre": "-pre",
        "1.2.3-pre": "pre", "foo-preview": "preview", "1.0.post1": "", "2024-01-05": "", "": "", "v01.2": "", "1.0-alpha": "alpha",
    }
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    assert {r.v: r.p for r in df.select("v", V.prerelease_part(F.col("v")).alias("p")).collect()} == cases
    semver = {"1.2.3": (1, 2, 3, ""), "v1.2.3-rc.1+b": (1, 2, 3, "rc.1"), "1.2": None, "01.2.3": None, "1.2.9007199254740992": None, "1.2.3-01": None, "1.2.3+b.": None}
    df = spark.createDataFrame([(v,) for v in semver], "v string")
    assert {r.v: r.s and tuple(r.s) for r in df.select("v", V.semver(F.col("v")).alias("s")).collect()} == semver


def test_constraints(spark):
    rows = [("1.2.3", 1, 2, 3, ""), ("1.3.0", 1, 3, 0, ""), ("2.0.0", 2, 0, 0, ""), ("2.0.0-rc.1", 2, 0, 0, "rc.1"), ("0.2.5", 0, 2, 5, ""), ("0.3.0", 0, 3, 0, ""), ("x", None, None, None, None)]
    df = spark.createDataFrame(rows, "v string, a long, b long, c long, p string")

    def met(text):
        row = ", ".join(f"cast({v!r} as {k.split()[1]}) as {k.split()[0]}" if v is not None else f"cast(null as {k.split()[1]}) as {k.split()[0]}" for v, k in zip(constraint_row(parse_constraint(text)), CONSTRAINT_COLUMNS.split(",")))
        joined = [r.v for r in df.selectExpr("*", *row.split(", ")).where(satisfies_row(F.col("a"), F.col("b"), F.col("c"), F.col("p"))).collect()]
        alone = [r.v for r in df.where(satisfies(parse_constraint(text), F.col("a"), F.col("b"), F.col("c"), F.col("p"))).collect()]
        assert joined == alone, text
        return alone

    assert met("^1.2") == ["1.2.3", "1.3.0"] and met("~1.2") == ["1.2.3"] and met("1") == ["1.2.3", "1.3.0"]
    assert met("^0.2.1") == ["0.2.5"] and met("^0") == ["0.2.5", "0.3.0"] and met(">=1.3 <2") == ["1.3.0"]
    assert met("2.0.0-rc.1") == ["2.0.0-rc.1"] and met(">=2.0.0-a <3") == ["2.0.0", "2.0.0-rc.1"] and met(">1.3.0,<=2") == ["2.0.0"]
    for text in ("", "latest", "2024-01-05", "1.1w", "^", "99999999999999999999"):
        assert parse_constraint(text) is None
    names = spark.createDataFrame([("3.1",), ("3.1.4",), ("3.11",), ("3.1-rc",), ("3.1%",)], "v string")
    assert [r.v for r in names.where(prefix_with_boundary(F.col("v"), "3.1")).collect()] == ["3.1", "3.1.4", "3.1-rc"]


def test_prerelease_precedence(spark):
    order = ["1", "2", "10", "alpha", "alpha.1", "alpha.beta", "beta", "rc"]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(order)], "k int, p string")
    assert [r.k for r in df.orderBy(V.prerelease_rank(F.col("p"))).collect()] == list(range(len(order)))
