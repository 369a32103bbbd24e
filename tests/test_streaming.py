"""A stream of evaluations: merged once, whatever comes again; late ones refused or dropped. Archives read as a stream too."""

import gzip
import json

import pytest

from catalith.operators.decode import clean_package, decode_latest, decode_packages, latest_package, read_archives, stream_entries
from catalith.streaming.incremental import ARRIVALS, merge_batch, stream_evaluations


def rows_of(seq, n, system="s"):
    return [(seq, system, f"N{k}", f"n{k}", "1", f"p{k}", "m", "h") for k in range(n)]


def test_stream(spark, rows, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for data in (rows_of(1, 3) * 2, rows_of(2, 2), rows_of(1, 3)):
        spark.createDataFrame(data, ARRIVALS).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        stream_evaluations(spark, source, folder, str(tmp_path / "check")).awaitTermination()
        got = spark.read.parquet(f"{folder}/rows")
        assert got.select("commit_seq", "name_key").distinct().count() == got.count() == 5
    again = spark.createDataFrame(rows_of(2, 2), ARRIVALS)
    merge_batch(folder)(again, 77)
    assert spark.read.parquet(f"{folder}/rows").count() == 5
    late = spark.createDataFrame(rows_of(0, 2) + rows_of(0, 1, "other"), ARRIVALS)
    with pytest.raises(ValueError, match="older"):
        merge_batch(folder)(late, 78)
    merge_batch(folder, late="drop")(late, 78)
    merge_batch(folder, late="drop")(late, 78)
    assert spark.read.parquet(f"{folder}/rows").count() == 6


HIDDEN = "_hiddenVersion"
PACKAGES = {"p": {"pname": "dot-v0.3", "outputs": {"out": "/nix/store/" + "a" * 32 + "-x", "bin": None}, "outputName": "out", "meta": {"_hiddenVersion": "v0.3", "platforms": [["b", ["a"]], {"x": 1}], "license": [{"fullName": "x"}, "mit"], "outputsToInstall": ["man", "out"]}}, "stub": {"outputs": []}}


def test_decoding(spark):
    p = clean_package("p", PACKAGES["p"], HIDDEN)
    assert (p["name"], p["version"], p["system"], p["store_hash"], p["license"], p["platforms"]) == ("dot", "v0.3", "x86_64-linux", "a" * 32, "mit", ["a", "b"])
    assert [(o["name"], o["default"]) for o in p["outputs"]] == [("out", True), ("man", True), ("bin", False)]
    same = json.loads(json.dumps(PACKAGES["p"]))
    same["meta"]["platforms"] = ["a", "b"]
    assert clean_package("other", same, HIDDEN)["content_hash"] == p["content_hash"] != clean_package("p", {**same, "version": "2"}, HIDDEN)["content_hash"]
    df = spark.createDataFrame([(1, "eval", json.dumps(PACKAGES)), (2, "latest", "{}"), (3, "eval", None)], "raw_id long, shape string, payload string")
    got = decode_packages(df, HIDDEN).collect()
    assert clean_package("p", PACKAGES["p"], None)["version"] == ""
    assert [(r.raw_id, r.attr_path, r.content_hash) for r in got] == [(1, "p", p["content_hash"])]


def test_records_of_both_shapes_have_one_address(spark):
    p = clean_package("p", PACKAGES["p"], HIDDEN)
    same = {k: p[k] for k in ("attr_path", "system", "store_hash", "store_name", "meta_name", "program", "summary", "description", "homepage", "license", "broken", "insecure", "platforms")}
    same |= {"store_version": p["version"], "meta_version": [p["meta_version"]], "outputs": [{**o, "nar": "cached"} for o in p["outputs"]], "commit_hash": "c"}
    got = latest_package(same)
    assert (got["meta_hash"], got["content_hash"]) == (p["meta_hash"], p["content_hash"]) and latest_package({**same, "program": "x"})["content_hash"] != p["content_hash"]
    odd = {"store_hash": 3, "platforms": "a", "meta_version": None, "outputs": {"name": None, "default": 1}, "broken": "yes"}
    made = latest_package(odd)
    assert (made["store_hash"], made["platforms"], made["meta_version"], made["outputs"], made["broken"]) == ("", ["a"], [], [{"name": "", "path": "", "default": False}], False)
    df = spark.createDataFrame([(1, "latest", json.dumps(json.dumps(same))), (2, "latest", json.dumps(same)[:-3]), (3, "eval", "{}"), (4, "latest", None), (None, "latest", json.dumps(odd))], "raw_id long, shape string, payload string")
    assert {r.raw_id: r.content_hash for r in decode_latest(df).collect()} == {1: p["content_hash"], None: made["content_hash"]} and decode_latest(df.limit(0)).count() == 0


def test_archives(spark, tmp_path):
    entries = {f"k{n}": {"v": ["x" * n, {"}": None}], "n": n} for n in range(2500)} | {"num": 12, "none": None}
    for name, doc in (("a.json.gz", entries), ("b.json.gz", {"version": 2, "packages": entries, "z": 1})):
        with gzip.open(tmp_path / name, "wt") as f:
            json.dump(doc, f)
    got = read_archives(spark, [str(tmp_path / "a.json.gz"), str(tmp_path / "b.json.gz")])
    assert got.count() == 2 * len(entries) + 1
    assert {r.attr_path: json.loads(r.package) for r in got.where("path like '%a.json.gz'").collect()} == entries
    for n in (1, 3, 1000):
        text = json.dumps({"a": [1, "}"], "b": 12}, indent=1)
        assert {k: json.loads(v) for k, v in stream_entries(iter([text[i : i + n] for i in range(0, len(text), n)]))} == {"a": [1, "}"], "b": 12}
    for bad in ('{"a":1', "[1]", '{"a" 1}', ""):
        with pytest.raises(ValueError):
            list(stream_entries(iter([bad])))
