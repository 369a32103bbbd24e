"""Orphans, snapshots, dense sums and nested records against plain versions, with their odd inputs."""

import datetime
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalith.operators import dense, skew
from catalith.operators.dense import dense_sums
from catalith.operators.nested import _parse_deep, child_items, parse, shred, state_of, subtype_table
from catalith.operators.references import Reference, orphan_counts, orphan_references
from catalith.operators.snapshots import snapshot_changes

DAY = datetime.datetime(2024, 1, 15)


@pytest.mark.parametrize("hot,most", [(10_000, 500_000), (5, 500_000), (5, 0)])
def test_orphans(spark, rows, hot, most, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", most)
    rng = random.Random(hot)
    keys = ["k0", "k1", "k2", "gone", "gone2", "", None]
    data = [(n, rng.choice(keys + ["gone"] * 5), DAY + datetime.timedelta(days=rng.randrange(90)), "x") for n in range(200)] + [(500, "gone", None, "x")]
    data += data[:30]
    arrived = {"k0": DAY, "k1": DAY + datetime.timedelta(days=45), "k2": None}
    df = spark.createDataFrame(data, "row_id int, k string, at timestamp_ntz, target string")
    parents = spark.createDataFrame([*arrived.items(), ("k1", DAY + datetime.timedelta(days=60)), (None, DAY)], "key string, arrived timestamp_ntz")
    refs = [Reference("with", F.col("k"), parents), Reference("without", F.col("k"), parents.select("key"))]
    got = orphan_references(df, "row_id", refs, period=F.date_format("at", "yyyy-MM"), moment=F.col("at"), hot_rows=hot)
    want = set()
    for n, k, at, _ in data:
        month = at and at.strftime("%Y-%m")
        if k and k not in arrived:
            want |= {(n, "with", month, "missing"), (n, "without", month, "missing")}
        elif k and at and arrived[k] and arrived[k] > at:
            want.add((n, "with", month, "late"))
    assert rows(got) == sorted(want, key=str)
    counted = Counter((t, p, r) for _, t, p, r in want)
    assert rows(orphan_counts(got)) == sorted(((*k, n) for k, n in counted.items()), key=str)
    none = orphan_references(df.limit(0), "row_id", refs, period=F.lit("x"), moment=F.col("at"))
    assert rows(none) == []


def test_hot_keys(spark, rows):
    df = spark.createDataFrame([("a", "x")] * 50 + [("b", None)] * 3 + [(None, "x")] * 80, "k string, o string")
    hot = skew.hot_keys(df, ["k", "o"], rows=10)
    assert rows(hot.table) == [("k", "a", 50), ("o", "x", 130)] and hot.count == 2 and rows(hot.of("k")) == [("a",)]
    assert skew.hot_keys(df.union(df), ["k"], rows=7).count == 1 and skew.hot_keys(df.limit(0), ["k"], rows=0).count == 0


@pytest.mark.parametrize("bucket", [200_000, 7])
def test_snapshots(spark, rows, bucket):
    rng = random.Random(bucket)
    members, contents = set(), []
    for scope in "xy":
        for seq in (1, 4, 5, 9):
            for k in rng.sample(range(40), 25):
                key = (f"n{k % 20}" if k else None, f"v{k // 20}")
                members.add((scope, seq, *key))
                contents.append((scope, seq, *key, rng.choice(["AA", "aa", "bb", None])))
    contents.append(("x", 4, "stub", "v", "zz"))
    schema = "scope string, seq int, name string, v string"
    data = [*members] * 2 + [(None, 1, "n", "v"), ("x", None, "n", "v")]
    got = snapshot_changes(
        spark.createDataFrame([(*m, "extra") for m in data], schema + ", change string"), spark.createDataFrame(contents * 2, schema + ", h string"),
        scope="scope", seq="seq", key=["name", "v"], content="h", bucket_rows=bucket,
    )
    held = {c[:4]: c[4] and c[4].lower() for c in contents}
    want = []
    for scope in "xy":
        for a, b in ((1, 4), (4, 5), (5, 9)):
            old, new = ({m[2:] for m in members if m[:2] == (scope, s)} for s in (a, b))
            want += [(scope, b, *k, "added") for k in new - old] + [(scope, b, *k, "removed") for k in old - new]
            want += [(scope, b, *k, "changed") for k in new & old if held[scope, a, *k] != held[scope, b, *k]]
    assert rows(got) == sorted(want, key=str)
    empty = spark.createDataFrame([], schema + ", h string")
    assert rows(snapshot_changes(empty, empty, scope="scope", seq="seq", key=["name", "v"], content="h")) == []


def test_snapshot_that_loses_a_bucket(spark, rows):
    """A bucket without a row in some snapshot still sees that the keys went."""
    data = [("x", 1, "a"), ("x", 1, "b"), ("x", 2, "b"), ("x", 3, "a"), ("x", 3, "b")]
    df = spark.createDataFrame(data, "scope string, seq int, k string")
    got = snapshot_changes(df, df.withColumn("h", F.lit("1")), scope="scope", seq="seq", key=["k"], content="h", bucket_rows=1)
    assert rows(got) == [("x", 2, "a", "removed"), ("x", 3, "a", "added")]


def test_dense_sums(spark, rows, monkeypatch):
    rng = random.Random(4)
    data = [(rng.choice(["hot"] * 8 + ["", None, *(f"k{n}" for n in range(60))]), rng.randrange(30), rng.choice([None, 1, -3, 1 << 60])) for _ in range(3000)]
    df = spark.createDataFrame(data, "k string, i int, n long").repartition(5)
    got = rows(dense_sums(df, {"text": "k", "number": "i"}, ["n"], blocks=3))
    want = Counter()
    sums = Counter()
    for k, i, n in data:
        for f, v in (("text", k), ("number", str(i))):
            if v is not None:
                want[f, v] += 1
                sums[f, v] += n or 0
    assert got == sorted(((*k, n, (sums[k] + (1 << 63)) % (1 << 64) - (1 << 63)) for k, n in want.items()), key=str)
    assert rows(dense_sums(df.limit(0), {"text": "k"})) == []
    monkeypatch.setattr(dense, "BLOCK_KEYS", 5)
    assert dense._blocks(df, ["k", "i"]) >= 15 and rows(dense_sums(df, {"text": "k", "number": "i"}, ["n"], sized=df.select("k", "i"))) == got


EVAL = {"p.a": {"version": "1", "system": "s", "outputs": {"out": "x", "": "y", "man": None}, "meta": {"platforms": ["  l ", ["d", [[]], ["l", {"names": ["no"]}]], 7, None, ""]}}, "p.b": {"outputs": ["out"], "meta": {"platforms": "l"}}, "p.c": 3}
LATEST = {"attr_path": "q", "outputs": [{"name": "out", "path": "p", "default": True}, {"path": "x"}, None, {"name": "out"}, {"name": ""}], "meta_version": "1.2"}
RECORDS = [
    (1, "eval", json.dumps(EVAL)),
    (2, "eval", json.dumps({"version": 2, "packages": EVAL})),
    (3, "eval", json.dumps({"version": "2", "packages": EVAL})),
    (4, "latest", json.dumps(json.dumps(LATEST))),
    (5, "latest", json.dumps(LATEST)[:-5]),
    (6, "latest", json.dumps({"outputs": {"name": "out"}, "meta_version": ["a", ["b"], 1, "a"]})),
    (7, "eval", None), (8, "eval", "[]"), (9, "eval", ""), (10, "other", "{}"), (11, None, "{}"), (12, "latest", "NaN"), (13, "latest", '"no json"'),
    (14, "latest", '{"attr_path": "x\\ud800", "meta_version": "v"}'),
    (16, "latest", json.dumps({"attr_path": "r", "platforms": " l "})), (17, "latest", json.dumps({"attr_path": "r", "platforms": ["l", [" d", ["l"]], 3, {"names": ["no"]}, ""]})),
    (18, "latest", json.dumps({"attr_path": "r", "platforms": [" l", "d"], "meta": {"platforms": ["no"]}})), (19, "latest", json.dumps({"attr_path": "r", "platforms": {"names": ["no"]}})),
    (15, "eval", '{"d": {"outputs": {}, "meta": {"platforms": ' + "[" * 3000 + '"deep"' + "]" * 3000 + "}}}"),
]


def test_nested(spark, rows):
    flat = shred(spark.createDataFrame([*RECORDS, *RECORDS[:3]], "raw_id long, shape string, payload string"))
    items = [("p.a", "outputs", "man"), ("p.a", "outputs", "out"), ("p.a", "platforms", "d"), ("p.a", "platforms", "l")]
    want = [(n, *i) for n in (1, 2) for i in items] + [(4, "q", "outputs", "out"), (4, "q", "meta_version", "1.2"), (6, None, "outputs", "out"), (6, None, "meta_version", "a"), (6, None, "meta_version", "b")]
    want += [(14, "x�", "meta_version", "v"), (15, "d", "platforms", "deep"), (16, "r", "platforms", "l"), *((n, "r", "platforms", p) for n in (17, 18) for p in "dl")]
    assert rows(child_items(flat)) == sorted(want, key=str)
    packages = subtype_table(flat, "packages")
    assert ("p.a", "1", "s") in {(r.attr_path, r.version, r.system) for r in packages.collect()} and packages.where("raw_id = 1").count() == 1
    assert rows(subtype_table(flat, "outputs_array").select("item", "path", "is_default")) == [("out", "p", True), ("out", None, None)]
    assert [rows(subtype_table(flat, f"platforms_{t}").where("raw_id > 15").select("raw_id", "ordinal", "depth", "item")) for t in ("single", "array", "nested")] == [[(16, 0, 0, "l")], [(18, 0, 1, "l"), (18, 1, 1, "d")], [(17, 0, 1, "l"), (17, 1, 2, "d"), (17, 2, 3, "l")]]
    assert rows(child_items(shred(spark.createDataFrame([], "raw_id long, shape string, payload string")))) == []


def test_automaton_and_deep_parser():
    assert [state_of(json.loads(x)) for x in ('[]', '["a"]', '["a",["b"]]', '[{"name":"x"}]', '["a",1]', '{"name":1}', '{"name":"x"}', "null")] == ["empty", "texts", "nested", "objects", "mixed", "object", "named", "null"]
    rng = random.Random(3)

    def value(k):
        r = rng.random()
        if k == 0 or r < 0.4:
            return rng.choice([None, True, 1.5, 3, 'a"b', "é", ""])
        return [value(k - 1) for _ in range(rng.randrange(4))] if r < 0.7 else {rng.choice("abcd"): value(k - 1) for _ in range(rng.randrange(4))}

    for _ in range(500):
        v = value(4)
        text = json.dumps(v, indent=rng.choice([None, 1]))
        assert _parse_deep(text) == v
        for bad in (text[:-1], text + "]", "{" + text):
            try:
                json.loads(bad)
            except ValueError:
                assert isinstance(_parse_deep(bad), object) and _parse_deep(bad) is parse("{")


def test_null_names_and_versions_are_no_parents(spark, rows, tmp_path):
    from catalith.plans import problems

    tables = {
        "packages": ("id int, name string", [(1, "Solid"), (2, None)]),
        "versions": ("package_id int, version string", [(1, None), (1, "1.0"), (2, "2.0"), (1, "")]),
        "commits": ("hash string, imported_at timestamp_ntz", [("c", DAY)]),
        "meta": ("hash string", [("m",)]),
        "variant_rows": ("row_id long, version_key string, meta_hash string, commit_hash string, loaded_at timestamp_ntz", [(n, k, "m", "c", DAY) for n, k in enumerate(["solid", "2.0", "SOLID\t1.0", "Solid\t", "\t2.0", "Solid", "solid\t2.0"])]),
    }
    for name, (schema, data) in tables.items():
        spark.createDataFrame([*data, *data[:1]], schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    want = [(n, "versions", "2024-01", "missing") for n in (0, 1, 4, 5, 6)]
    assert rows(problems.p3_found(spark, str(tmp_path))) == want
    assert rows(problems.p3_counts(spark, str(tmp_path))) == [("versions", "2024-01", "missing", 5)]
