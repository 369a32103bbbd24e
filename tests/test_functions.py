"""Names, paths, trigrams and display functions."""

import datetime

from pyspark.sql import functions as F

from catalith.functions import display as D
from catalith.functions import paths as P
from catalith.functions.names import name_key, name_key_of, nfd, normalized
from catalith.functions.trigram import similarity


def one(spark, column, **values):
    kinds = {str: "string", int: "long", bool: "boolean", bytes: "binary", datetime.datetime: "timestamp_ntz"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_names(spark):
    df = spark.createDataFrame([("Café",), ("CAFÉ",), (None,), ("",), ("ABC",)], "n string")
    assert [r[0] for r in df.select(name_key(F.col("n"))).collect()] == ["café", "café", None, "", "abc"]
    assert [r[0] for r in df.select(nfd(F.col("n"))).collect()][:3] == ["Café", "CAFÉ", None]
    assert name_key_of("ÀB") == "àb" and normalized(" é ") == "é"


def test_trigrams(spark):
    for a, b, want in (("yq-py", "py", 0.5), ("py-000", "py", 3 / 7), ("-", "-", 0.0), ("Go", "go", 1.0), ("", "x", 0.0)):
        assert abs(one(spark, similarity(F.col("a"), F.col("b")), a=a, b=b) - want) < 1e-9


def test_paths(spark):
    for path, want in {"go_1_19": "go", "gopls": "gopls", "python3": "python", "python312Full": "python-full", "jdk17_headless": "jdk-headless", "nodejs-18_x": "nodejs", "nodejs": "nodejs"}.items():
        assert one(spark, P.canonical_name(F.col("p")), p=path) == want
    h = "a" * 32
    cases = {
        f"/nix/store/{h}-go-1.2": (h, "go", "1.2"), f"{h}-a-b-2-c": (h, "a-b", "2-c"), f"{h}-x-": (h, "x-", ""), f"{h}--1": (h, "-1", ""),
        f"{h}-a--b": (h, "a", "-b"), h: (h, "", ""), "short": ("", "", ""), f"{h}-n-1.drv": (h, "n", "1.drv"),
    }
    for path, want in cases.items():
        assert tuple(one(spark, P.split_store_path(F.col("p")), p=path)) == want, path
    assert tuple(one(spark, P.arch_os(F.col("s")), s="riscv64-linux")) == ("", "")
    assert tuple(one(spark, P.split_reference(F.col("r")), r="@x@1")) == ("@x@1", None)
    assert tuple(one(spark, P.split_reference(F.col("r")), r="x@1@2")) == ("x", "1@2")
    xml = "<A><Prefix>r/1/</Prefix><Prefix>r/2/</Prefix><Next>t</Next></A>"
    assert one(spark, P.listed_prefixes(F.col("x")), x=xml) == ["r/1/", "r/2/"] and one(spark, P.xml_tag(F.col("x"), "Next"), x=xml) == "t"
    assert tuple(one(spark, P.parse_archive_name(F.col("f")), f="/d/hidden-x86_64-linux-0123abc.json.gz")) == ("hidden", "x86_64-linux", "0123abc")


def test_display(spark):
    now = datetime.datetime(2026, 1, 1)
    assert one(spark, D.rfc3339(F.col("t")), t=datetime.datetime(2024, 2, 3, 4, 5, 6, 789000)) == "2024-02-03T04:05:06Z"
    assert one(spark, D.escape_like(F.col("s")), s="a%b_c\\") == "a\\%b\\_c\\\\"
    assert one(spark, D.highlight(F.col("s"), "PY"), s="<Python>") == "&lt;<mark>Py</mark>thon&gt;" and one(spark, D.highlight(F.col("s"), "z"), s="a&b") == "a&amp;b"
    assert [one(spark, D.byte_size(F.col("n")), n=n) for n in (5, 1536, 5 << 30)] == ["5 B", "1.5 KiB", "5.0 GiB"]
    ages = {30: "just now", 90: "2 minutes ago", 3600: "1 hour ago", 86400 * 3: "3 days ago", 86400 * 400: "13 months ago", 86400 * 1000: "3 years ago", -5: "in the future"}
    for seconds, want in ages.items():
        assert one(spark, D.ago(F.col("t"), F.lit(now)), t=now - datetime.timedelta(seconds=seconds)) == want
    df = spark.createDataFrame([(1, "a\tb\\", True, b"\x01\xff", ["x"], None)], "i int, s string, b boolean, y binary, l array<string>, n string")
    assert df.select(D.copy_line(df.dtypes)).first()[0] == '1\ta\\tb\\\\\tt\t\\\\x01ff\t["x"]\t\\N'
    df = spark.createDataFrame([("", 0, False, [], "k", 2)], "a string, b int, c boolean, d array<int>, e string, f int")
    assert df.select(D.omit_empty(df.dtypes)).first()[0] == '{"e":"k","f":2}'
    assert one(spark, D.describe_query(F.col("p"), F.lit(""), F.col("v"), F.lit(None).cast("string")), p='a"', v="1") == 'phrase = "a\\"" = "^\\"a\\"\\"\\" OR ^\\"a\\"\\"\\"* OR \\"a\\"\\"\\" OR \\"a\\"\\"\\"*" && version = "1"'
    assert len(one(spark, D.etag(F.col("s")), s="x")) == 27


def test_links_and_times(spark):
    name, at = F.col("n"), F.col("t")
    assert one(spark, D.package_path(name), n="a b/é!'()*~@") == "/pkg/a%20b%2F%C3%A9!'()*~%40" and one(spark, D.package_path(name, F.lit("1+2")), n="x") == "/pkg/x/1%2B2"
    assert one(spark, D.query_path(F.lit("/s"), q=name, v=F.lit(""), w=F.lit(None).cast("string")), n="a&b") == "/s?q=a%26b" and one(spark, D.query_path(F.lit("/s"), q=name), n="") == "/s"
    t = datetime.datetime(2024, 2, 3, 4, 5, 6, 789000)
    assert one(spark, D.time_tag(at), t=t) == '<time datetime="2024-02-03T04:05:06.789Z">2024-02-03 04:05 UTC</time>'
    assert one(spark, D.day_tag(at), t=t) == '<time datetime="2024-02-03T04:05:06.789Z" title="2024-02-03T04:05:06.789Z">2024-02-03</time>'
    assert one(spark, D.ago_tag(at, F.lit(t)), t=t).endswith('">just now</time>') and one(spark, D.short_system(name), n="x86_64-linux-musl") == "x86_64 linux-musl"
