"""Scenarios over a small catalog: lookups, latest rules, ranking, common commits, imports and history filled in."""

import datetime

import pytest
from pyspark.sql import functions as F

from catalith.operators import history, lookup, merge, phrase, render, status
from catalith.sources.catalog import Catalog

DAY = datetime.datetime(2026, 1, 1)
LINUX, MAC = "x86_64-linux", "aarch64-darwin"
SCHEMAS = {
    "packages": "id int, name string",
    "versions": "id int, package_id int, version string, sort_key binary, prerelease boolean, semver_major long, semver_minor long, semver_patch long, semver_pre string",
    "variants": "id int, version_id int, system string, attr_path string, meta_id int, commit_seq int, store_hash string, store_name string, meta_name string, meta_version array<string>, program string, broken boolean, insecure boolean, content_hash string",
    "variant_ranges": "variant_id int, first_seq int, last_seq int, seeded boolean, backfill_last_seq int",
    "meta": "id int, hash string, summary string, description string, homepage string, license string, platforms array<string>",
    "commits": "seq int, hash string, committed_at timestamp_ntz, imported_at timestamp_ntz",
    "commit_systems": "commit_seq int, system string, imported_at timestamp_ntz, nix_version string",
    "stage_keys": "commit_seq int, system string, name string, name_key string, version string, attr_path string, meta_hash string, content_hash string",
    "stage_variants": "commit_seq int, system string, name_key string, version string, attr_path string, meta_hash string, store_hash string, store_name string, broken boolean, insecure boolean, content_hash string",
    "stage_backfill_ranges": "system string, name_key string, version string, attr_path string, first_seq int, last_seq int, next_seq int",
}


def key(*numbers):
    return b"".join(bytes([4, len(str(n))]) + str(n).encode() for n in numbers) + b"\x02"


def semver(i, package, v, pre=None):
    n = [int(x) for x in v.split("-")[0].split(".")]
    return (i, package, v if pre is None else f"{v}-{pre}", key(*n) if pre is None else key(*n)[:-1] + b"\x01" + pre.encode() + b"\x02", pre is not None, *n, pre)


def variant(i, version, system, path, seq=1, broken=False, content=None):
    return (i, version, system, path, 1, seq, "s" * 32, path, f"{path}-1", ["1"], "", broken, False, content or f"h{i}")


TABLES = {
    "packages": [(1, "python"), (2, "Go"), (3, "go-task"), (4, "pythonqt"), (5, "gone")],
    "versions": [semver(1, 1, "3.11.0"), semver(2, 1, "3.12.0"), semver(3, 1, "3.13.0", "rc1"), semver(4, 2, "1.21.0"), semver(5, 2, "1.22.0"), semver(6, 3, "3.1.0"), semver(7, 4, "2017.3.30"), semver(8, 4, "2.0.0"), semver(9, 5, "1.0.0", "pre")],
    "variants": [
        variant(1, 1, LINUX, "python311"), variant(2, 2, LINUX, "python312"), variant(3, 2, MAC, "python312"), variant(4, 3, LINUX, "python313"),
        variant(5, 4, LINUX, "go"), variant(6, 5, LINUX, "go", broken=True), variant(7, 5, LINUX, "go_1_22", broken=True), variant(8, 6, LINUX, "go-task"),
        variant(9, 7, LINUX, "set.pythonqt"), variant(10, 8, LINUX, "set.pythonqt"), variant(11, 9, MAC, "gone"),
    ],
    "variant_ranges": [
        (1, 1, None, False, None), (2, 2, None, False, None), (3, 1, 3, False, None), (4, 3, None, False, None), (5, 1, None, False, None), (6, 2, None, False, None),
        (7, 2, None, False, None), (8, 1, 1, True, None), (9, 1, 2, False, None), (10, 3, None, False, None), (11, 2, 2, False, 2), (2, 1, 1, True, None),
    ],
    "meta": [(1, "m1", "a summary", "", "", "open", [LINUX, "riscv"])],
    "commits": [(n, f"{n:040x}", DAY + datetime.timedelta(days=n), DAY) for n in range(1, 6)],
    "commit_systems": [(n, s, DAY + datetime.timedelta(days=n), None) for n in range(1, 6) for s in (LINUX, MAC) if not (s == MAC and n > 3)],
    "stage_keys": [
        (5, LINUX, "Python", "python", "3.11.0", "python311", "m1", "H1"), (5, LINUX, "python", "python", "3.12.0", "python312", "m1", "new"),
        (5, LINUX, "Fresh", "fresh", "1.0", "fresh", "m9", "x"), (5, LINUX, "fresh", "fresh", "1.0", "fresh", "m9", "x"), (5, LINUX, "Go", "go", "1.23.0", "go", "m1", "y"),
        (5, LINUX, "pythonqt", "pythonqt", "2017.3.30", "set.pythonqt", "m1", "h9"),
    ],
    "stage_variants": [(n, LINUX, "k", "1", "p", "m", "s", "p", False, False, h) for n, h in ((1, "a"), (2, "A"), (4, "b"), (5, "b"))] + [(3, LINUX, "k", "1", "p", "m", "", "p", False, False, "b"), (3, LINUX, "o", "1", "p", "m", "s", "p", False, False, "c")],
    "stage_backfill_ranges": [(MAC, "python", "3.12.0", "python312", 1, 3, None), (LINUX, "python", "3.12.0", "python312", 1, 1, 2), (MAC, "gone", "1.0.0-pre", "gone", 1, 3, None), (LINUX, "none", "1", "x", 1, 2, None)],
}


@pytest.fixture(scope="module")
def c(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("catalog")
    for name, data in TABLES.items():
        spark.createDataFrame([*data, *data[:2]], SCHEMAS[name]).coalesce(1).write.parquet(f"{base}/{name}.parquet")
    return Catalog(spark, str(base))


def test_latest_rules(c):
    latest = {r.package_id: r.version for r in lookup.latest_versions(c).collect()}
    # No prerelease; what isn't broken; what was seen last beats a higher version; a prerelease when there is nothing else.
    assert latest == {1: "3.12.0", 2: "1.21.0", 3: "3.1.0", 4: "2.0.0", 5: "1.0.0-pre"}
    assert {r.package_id: r.version for r in lookup.latest_versions(c, system=MAC).collect()} == {1: "3.12.0", 5: "1.0.0-pre"}
    assert 5 not in {r.package_id for r in lookup.latest_versions(c, prereleases="never").collect()}
    got = lookup.latest_for(c, ["PYTHON", "nothing", "go_1_22"]).collect()
    assert [(r.ord, r.version, r.systems) for r in got] == [(1, "3.12.0", f"{MAC},{LINUX}"), (2, None, None), (3, "1.22.0", LINUX)]


def test_lookup_and_constraints(c):
    ids = lambda df: sorted(r.variant_id for r in df.collect())
    assert ids(lookup.variants_of(c, "GO")) == [5, 6, 7] and ids(lookup.variants_of(c, "go")) == [5, 6, 7] and ids(lookup.variants_of(c, "python312")) == [2, 3]
    assert [r.version for r in lookup.versions_by_name(c, "python").collect()] == ["3.13.0-rc1", "3.12.0", "3.12.0", "3.11.0"]
    asked = [("python", "3.11"), ("python", "^3.11"), ("python", ">=4"), ("go", "1.2"), ("pythonqt", "2017"), ("no", "1")]
    assert [r.version for r in lookup.constrained_versions(c, asked).collect()] == ["3.11.0", "3.12.0", None, None, "2017.3.30", None]
    for (name, text), want in zip(asked, ["3.11.0", "3.12.0", None, None, "2017.3.30", None]):
        assert {r.version for r in lookup.resolve(c, name, text).collect()} == ({want} if want else set())
    assert {(r.version, r.system) for r in lookup.resolve(c, "python", "latest").collect()} == {("3.12.0", LINUX), ("3.12.0", MAC)}
    assert {r.version for r in lookup.resolve(c, "gone", "latest").collect()} == {"1.0.0-pre"}
    many = lookup.constrained_versions(c, asked * 100).collect()
    assert len(many) == 600 and [r.version for r in many[-6:]] == ["3.11.0", "3.12.0", None, None, "2017.3.30", None]
    with pytest.raises(ValueError):
        lookup.dispatch(c)
    assert lookup.resolve(c, "python", "latest").limit(1).count() == 1 and lookup.by_name_and_version(c, "python", "latest", prereleases_last=True, limit=1).count() == 1 and lookup.by_name_and_version(c, "python", "latest", prereleases_last=True, limit=None).count() == 2
    assert lookup.dispatch(c, name=" python ", system="X86_64-LINUX").count() == 3


def test_phrase(c):
    names = lambda p, **k: [r.name for r in phrase.rank_phrase(c, p, **k).collect()]
    assert names("python")[:2] == ["python", "pythonqt"] and names("go")[0] == "Go" and names("golang") == ["Go"] and names("-") == []
    assert names("py", hits=None)[:2] == ["python", "pythonqt"] and [phrase.parse_releases(x) for x in (None, "all", "7", "99999999999999999999")] == [None, "all", 7, "all"]
    for bad in ("0", "-1", "x", "", "1.5", "\u0661"):
        with pytest.raises(ValueError):
            phrase.parse_releases(bad)
    assert phrase.search_phrase(c, "python", latest_only=False, hits=None, rows=None).count() == 5 and phrase.search_phrase(c, "python", latest_only=False, rows=2).count() == 2
    assert names("py", hits=1) == ["python"] and "go-task" in names("task")
    rows = phrase.search_phrase(c, "python", releases=1).collect()
    assert [(r.name, r.version, r.system) for r in rows] == [("python", "3.12.0", MAC), ("pythonqt", "2.0.0", LINUX)] and '"version":"3.13.0-rc1"' in rows[0].releases
    assert [r.version for r in phrase.search_phrase(c, "pythonqt", latest_only=False).collect()][:2] == ["2017.3.30", "2.0.0"]


def test_common_commit(c, rows):
    assert [(r.version_id, r.commit_seq) for r in history.common_commits(c).collect()] == [(2, 3)]
    assert {r.commit_hash for r in history.at_common_commit(c, lookup.resolve(c, "python", "3.12")).collect()} == {f"{3:040x}"}
    other = lookup.resolve(c, "python", "3.12").limit(1).withColumn("system", F.lit("riscv64-linux"))  # a system without live ranges keeps its commit
    assert {r.commit_hash for r in history.at_common_commit(c, other).collect()} == {f"{1:040x}"}
    spans = [(4, "a", 1, 9), (4, "a", 2, 3), (4, "b", 2, 2), (4, "b", 6, 4), (5, "a", 1, None), (5, "b", 3, 1), (1, "a", 1, 5), (1, "a", 8, 9), (1, "b", 4, 8), (2, "a", 1, 2), (2, "b", 3, 4), (3, "a", 1, 7)]
    df = c.spark.createDataFrame(spans, "e int, g string, lo int, hi int")
    assert rows(history.newest_common(df, "e", "g", "lo", "hi")) == [(1, 2, 8), (2, 2, None), (3, 1, 7), (4, 2, 2)]


def test_runs_and_content(c, rows):
    data = history.evaluated_rows(c)
    assert rows(history.presence_runs(c, data).select("name_key", "first_seq", "last_seq", "next_seq")) == [("k", 1, 2, 3), ("k", 4, 5, None), ("o", 3, 3, 4)]
    assert rows(history.content_first_seen(data).select("name_key", "content_hash", "content_seq")) == [("k", "b", 4), ("o", "c", 3)]


def test_import(c, rows):
    evals = merge.newest_evaluations(c)
    assert rows(merge.missing_packages(c, evals)) == [("fresh", "Fresh")] and rows(merge.missing_meta(c, evals)) == [("m9",)]
    assert rows(merge.missing_versions(c, evals)) == [(2, "go", "1.23.0")]
    assert rows(merge.changed_variants(c, evals).select("attr_path", "variant_id")) == [("python312", 2)]
    assert rows(merge.previous_imports(c, evals)) == [(LINUX, 5, 4)]
    assert rows(merge.ranges_to_close(c, evals)) == [(10, 3, 4), (4, 3, 4), (5, 1, 4), (6, 2, 4), (7, 2, 4)]
    assert rows(merge.ranges_to_open(c, evals)) == [(9, 5)]
    after = rows(merge.merged_ranges(c, evals))
    assert (9, 5, None, False, None) in after and (4, 3, 4, False, None) in after and len(after) == 13
    ratio = merge.change_ratios(merge.changed_variants(c, evals), evals, merge.previous_imports(c, evals))
    assert rows(ratio) == [(LINUX, 5, 1, False)]
    new = c.spark.createDataFrame([(1, LINUX, "python311", 9, "H1"), (2, LINUX, "python312", 0, "h2"), (4, LINUX, "go", 0, "other"), (77, LINUX, "n", 3, "n")], "version_id int, system string, attr_path string, commit_seq int, content_hash string")
    late = {(r.version_id, r.attr_path): (r.commit_seq, r.content_hash) for r in merge.upserted_variants(c, new, conditional=True).collect()}
    assert late[1, "python311"] == (9, "h1") and late[2, "python312"] == (0, "h2") and late[4, "go"] == (1, "h5") and late[77, "n"] == (3, "n")
    assert {(r.version_id, r.attr_path): r.commit_seq for r in merge.upserted_variants(c, new).collect()}[4, "go"] == 0


def test_history_filled_in(c, rows):
    staged = merge.staged_ranges(c)
    assert rows(staged) == [(11, MAC, 1, 3, None), (2, LINUX, 1, 1, 2), (3, MAC, 1, 3, None)]
    assert rows(merge.covered_points(c, staged)) == [(2, 1)]
    assert rows(merge.overlapping_ranges(c, staged)) == [(11, 1, 3, 2, 2, "earlier backfill"), (3, 1, 3, 1, 3, "forward import")]
    assert rows(merge.stale_parts(c, staged)) == [(11, 2, True)]
    after = rows(merge.backfilled_ranges(c, staged))
    assert (2, 1, None, False, 1) in after and (11, 1, 3, False, 3) in after and (2, 1, 1, True, None) not in after and (3, 1, 3, False, None) in after
    problems = merge.incomplete_evaluations(c, c.raw("stage_keys"), [LINUX], DAY + datetime.timedelta(days=3), 4)
    assert rows(problems) == [(3, LINUX, "missing"), (4, LINUX, "missing"), (5, LINUX, "extra")]


def test_status(c, rows):
    got = {r.system: (r.imports, r.newest_seq, r.behind) for r in status.system_status(c).collect()}
    assert got == {LINUX: (5, 5, 0), MAC: (3, 3, 2)}
    assert rows(status.commit_ends(c).select("place", "seq")) == [("newest", 5), ("oldest", 1)]
    assert rows(status.incomplete_commits(c, [LINUX, MAC]).select("seq", "missing")) == [(4, MAC), (5, MAC)]
    assert {r.table_name: r.n_rows for r in status.row_counts(c).collect()}["variants"] == 11
    assert [r.package_id for r in status.page_after(c, 2, 2).collect()] == [3, 4] and status.page_start(c, 2, 2).first()[0] == 2 and status.page_start(c, 9, 2).count() == 0
    assert rows(status.batches(c.packages("package_id"), ["package_id"], 2)) == [(1, 0), (2, 0), (3, 1), (4, 1), (5, 2)]
    listed = c.spark.createDataFrame([(f"{n:040x}"[:39], n) for n in (1, 2)] + [("abc", 3), ("abd", 4), ("old", 1)], "short_hash string, number int")
    assert [r.number for r in status.pending_commits(c, listed, 1).collect()] in ([3], [1])
    assert rows(status.canonical_spellings(c).where("spellings > 1")) == []
    df = c.spark.createDataFrame([(1, "g", 1, 1), (2, "g", 2, 3), (3, "g", 3, 2), (4, "h", 1, 9)], "i int, g string, old int, new int")
    assert rows(status.order_divergences(df, "g", "old", "new", "i")) == [(3, 3)]


def test_responses(c, rows):
    rel = {r.version_id: r for r in render.release_rows(lookup.result_rows(c, c.shown_variants())).collect()}
    assert rel[2].platforms_summary == "Linux and macOS (Apple Silicon only)" and len(rel[2].platforms) == 2 and rel[5].broken and len(rel[5].platforms) == 1
    assert '"version":"3.12.0"' in render.package_document(lookup.versions_by_name(c, "python")).first()[0]
    doc = render.resolve_document(lookup.resolve(c, "python", "3.12")).first()[0]
    assert doc.startswith('{"name":"python","version":"3.12.0"') and f'"{MAC}":' in doc
    assert render.resolve_document(lookup.resolve(c, "python", "99")).count() == 0
    outs = c.spark.createDataFrame([(1, LINUX, "out", True, 0), (1, MAC, "out", True, 1), (1, LINUX, "dev", False, 2), (2, LINUX, "out", True, 0), (3, "x", "o", False, 0), (4, LINUX, "o", True, 0), (4, LINUX, "o", None, 1), (4, MAC, "p", True, 2)], "v int, system string, name string, is_default boolean, ordinal int")
    assert rows(render.outputs_summary(outs, ["v"], ["ordinal"])) == [(1, "out, dev (Linux only)"), (2, ""), (3, ""), (4, "p (macOS only), o (Linux only)")]
    legacy = render.legacy_versions(lookup.result_rows(c, c.shown_variants())).where("version_id = 5").first()
    assert (legacy.attr_paths, legacy.platforms) == ("go,go_1_22", LINUX)
    runs = c.spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, None), (6, None)], "n int, k string")
    assert [r.run for r in lookup.consecutive_groups(runs, [], [F.asc("n")], "k").orderBy("n").collect()] == [0, 0, 1, 2, 3, 3]


def test_whole_import(c, rows, tmp_path):
    from catalith.operators.importing import changes, current, imported, publish

    evals = c.raw("stage_keys")
    contents = evals.select("commit_seq", "system", "name_key", "version", "attr_path", "meta_hash", F.lit("s").alias("store_hash"), F.lit("n").alias("store_name"), F.lit(False).alias("broken"), F.lit(False).alias("insecure"), "content_hash")
    metas = c.spark.createDataFrame([("M9", "new", "", "", "", []), ("m1", "other", "", "", "", [])], "meta_hash string, summary string, description string, homepage string, license string, platforms array<string>")
    before = c.raw("commit_systems")
    c._raw["commit_systems"] = before.where(~((F.col("commit_seq") == 5) & (F.col("system") == LINUX)))
    publish(imported(c, evals, contents, DAY, metas), str(tmp_path), 1)
    c._raw["commit_systems"] = before
    new = current(c.spark, str(tmp_path))
    assert rows(new.packages("package_id", "name"))[-1:] == [(6, "Fresh")] and new.packages().count() == 6
    made = {(r.package_id, r.version): r for r in new.versions().where("version_id > 9").collect()}
    assert set(made) == {(2, "1.23.0"), (6, "1.0")} and made[2, "1.23.0"].semver_minor == 23 and bytes(made[2, "1.23.0"].sort_key) == key(1, 23, 0)
    got = {r.attr_path: r for r in new.variants().where("commit_seq = 5").collect()}
    assert set(got) == {"python312", "fresh", "go"} and got["python312"].variant_id == 2 and got["fresh"].meta_id == 2 and got["go"].content_hash == "y"
    ranges = rows(new.ranges("variant_id", "first_seq", "last_seq"))
    assert (10, 3, 4) in ranges and (9, 5, None) in ranges and (1, 1, None) in ranges and (3, 1, 3) in ranges and sum(r[1] == 5 for r in ranges) == 3
    assert [r.name for r in new.raw("search_terms").where("attr_path = 'fresh'").collect()] == ["Fresh"] and {r.table_name: r.n_rows for r in new.raw("row_counts").collect()}["packages"] == 6
    assert rows(new.packages_named(c.spark.createDataFrame([("fresh",)], "name_key string")).select("package_id")) == [(6,)]  # by the stored key
    again = imported(new, evals, contents, DAY, metas)
    assert {tuple(r)[3:] for r in changes(new, again).collect()} == {(0, 0)}
    with pytest.raises(ValueError, match="would not follow"):
        publish(again, str(tmp_path), 1)
    assert current(c.spark, str(tmp_path)).base == new.base
    for name, df in again.items():
        assert df.count() == new.raw(name).distinct().count(), name
    with pytest.raises(ValueError, match="older"):
        imported(new, evals.withColumn("commit_seq", F.lit(-1)), contents, DAY)


def test_commits_that_arrive_with_an_import(c, rows):
    from catalith.operators.importing import imported, placed_commits

    late, new = DAY + datetime.timedelta(days=3), DAY + datetime.timedelta(days=9)
    listed = lambda *data: c.spark.createDataFrame(data, "hash string, committed_at timestamp_ntz")
    placed = placed_commits(c, listed(("BB", new + datetime.timedelta(days=1)), ("aa", new), ("bb", new + datetime.timedelta(days=2)), (f"{5:040X}", DAY), (None, DAY)), DAY)
    assert rows(placed.where("seq > 4").select("seq", "hash")) == [(5, f"{5:040x}"), (6, "aa"), (7, "bb")]
    for bad in (("cc", late), ("cc", DAY + datetime.timedelta(days=5)), ("cc", None)):
        with pytest.raises(ValueError, match="not newer"):
            placed_commits(c, listed(bad), DAY)
    evals = c.raw("stage_keys").where("commit_seq = 5").drop("commit_seq").withColumn("commit_hash", F.lit("AA"))
    contents = evals.select("commit_hash", "system", "name_key", "version", "attr_path", "meta_hash", F.lit("s").alias("store_hash"), F.lit("n").alias("store_name"), F.lit(False).alias("broken"), F.lit(False).alias("insecure"), "content_hash")
    after = imported(c, evals, contents, DAY, commits=listed(("aa", new)))
    assert after["commits"].where("seq = 6 and hash = 'aa'").count() == 1 and rows(after["commit_systems"].where("commit_seq > 5").select("commit_seq", "system")) == [(6, LINUX)]
    assert rows(after["variants"].where("commit_seq = 6").select("attr_path", "content_hash")) == [("fresh", "x"), ("go", "y"), ("python312", "new")]


def test_whole_backfill(c, rows):
    from catalith.operators.importing import backfilled, changes

    dated = [(LINUX, 1, "python", "3.12.0", "python312", "m1", "s", "n", False, False, "h2"), (LINUX, 2, "old", "0.9", "old", "m7", "s", "n", False, False, "o")]
    dated = c.spark.createDataFrame(dated, "system string, commit_seq int, name_key string, version string, attr_path string, meta_hash string, store_hash string, store_name string, broken boolean, insecure boolean, content_hash string")
    schema = SCHEMAS["stage_backfill_ranges"]
    ranges = c.spark.createDataFrame([(LINUX, "python", "3.12.0", "python312", 1, 1, 2), (LINUX, "old", "0.9", "old", 2, 3, None), (MAC, "gone", "1.0.0-pre", "gone", 1, 1, None)], schema)
    metas = c.spark.createDataFrame([("m7", "then", "", "", "", [])], "meta_hash string, summary string, description string, homepage string, license string, platforms array<string>")
    windows = c.spark.createDataFrame([(LINUX, 1, 3), (MAC, 1, 3)], "system string, first_seq int, last_seq int")
    after = backfilled(c, ranges, dated, metas, windows)
    assert rows(after["packages"].where("id > 5").select("id", "name")) == [(6, "old")] and after["meta"].count() == 2
    made = {r.attr_path: r for r in after["variants"].collect() if r.id in (2, 12)}
    assert made["python312"].commit_seq == 1 and made["old"].store_hash == "s" and made["old"].meta_id == 2  # the same content moves its date back
    got = rows(after["variant_ranges"].select("variant_id", "first_seq", "last_seq", "backfill_last_seq"))
    assert (2, 1, None, 1) in got and (12, 2, 3, 3) in got and (11, 1, 1, 1) in got and not any(r[:2] == (11, 2) for r in got)  # the stale part went
    assert rows(after["search_terms"].where("package_id = 6").select("attr_path")) == [("old",)]
    again = Catalog(c.spark, c.base)
    again._raw = {**c._raw, **after}
    repeated = backfilled(again, ranges, dated, metas, windows)
    assert {tuple(r)[3:] for r in changes(again, {k: repeated[k] for k in ("packages", "variants", "variant_ranges")}).collect()} == {(0, 0)}
    with pytest.raises(ValueError, match="refused"):
        backfilled(c, c.raw("stage_backfill_ranges"), dated)
    # Only part of what an earlier backfill had joined to a live range is staged now: the range begins at the import after it again.
    again._raw["stage_backfill_ranges"] = c.spark.createDataFrame([(LINUX, "python", "3.12.0", "python312", 3, 3, None)], schema)
    whole = c.spark.createDataFrame([(LINUX, 1, 3)], "system string, first_seq int, last_seq int")
    assert rows(merge._without_stale(again, merge.staged_ranges(again), whole).where("variant_id = 2").select("first_seq", "last_seq", "backfill_last_seq")) == [(2, None, None)]


def test_import_of_an_archive(c, rows, tmp_path, capsys):
    import gzip
    import json

    from catalith.cli import main
    from catalith.operators.importing import current

    made = lambda out, **meta: {"pname": "x", "version": "1.30.0", "system": "other", "outputs": {"out": out}, "outputName": "out", "meta": {"description": "d", **meta}}
    packages = {"go_1_30": made("/nix/store/" + "b" * 32 + "-go"), "new": {**made("/nix/store/" + "c" * 32 + "-new"), "version": ""}, "dot": {**made("/nix/store/" + "d" * 32 + "-dot", hid="v2"), "version": ""}, "listed": {"outputs": []}}
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        json.dump({"version": 2, "packages": packages}, f)
    asked = ["import", c.base, str(tmp_path / "a.json.gz"), "--commit", "F" * 40, "--date", "2026-02-01T00:00:00", "--system", LINUX, "--hidden-field", "hid", "--to", str(tmp_path)]
    main(asked)
    new = current(c.spark, str(tmp_path))
    got = {r.attr_path: r for r in new.variants().where("commit_seq = 6").collect()}
    assert set(got) == {"go_1_30", "dot"} and got["go_1_30"].system == LINUX and got["go_1_30"].meta_id == got["dot"].meta_id == 2 and len(got["dot"].content_hash) == 64
    assert rows(new.packages("package_id", "name").where("package_id > 5")) == [(6, "dot")] and new.commits().where(F.col("hash") == "f" * 40).count() == 1
    assert {r.version for r in lookup.versions_by_name(new, "go").collect()} == {"1.30.0", "1.22.0", "1.21.0"}
    with pytest.raises(SystemExit, match="need"):
        main(asked[:3])
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        json.dump({"stub": made("")}, f)
    with pytest.raises(SystemExit, match="no store path"):
        main(asked)


def test_two_runs_cannot_publish_one_catalog(c, tmp_path):
    from catalith.operators.importing import _pointers, current, publish

    with pytest.raises(ValueError, match="nothing is published"):
        current(c.spark, str(tmp_path))
    first = publish({"packages": c.raw("packages"), **{t: c.raw(t) for t in status.COUNTED}}, str(tmp_path))
    path, fs = _pointers(c.spark, str(tmp_path))
    fs.create(c.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "2"), False).close()  # another run is about to name its catalog
    with pytest.raises(ValueError, match="another run"):
        publish({t: c.raw(t) for t in status.COUNTED}, str(tmp_path))
    assert current(c.spark, str(tmp_path)).base == first


def test_command_line(c, capsys, tmp_path):
    from catalith.cli import main

    for words, want in ((["resolve", c.base, "go"], '"version":"1.21.0"'), (["counts", c.base], '"n_rows":11'), (["search", c.base, "python"], '"ord":1'), (["backfill-list", c.base, MAC, "--size", "1"], '"batch":1')):
        main(words)
        assert want in capsys.readouterr().out, words
    with pytest.raises(SystemExit, match="refused"):
        main(["backfill", c.base])
    main(["import", c.base, "--dry-run"])
    assert '"table_name":"variants"' in capsys.readouterr().out and not (tmp_path / "published").exists()
    (tmp_path / "page.xml").write_text(f"<L><Prefix>r/12.{3:040x}/</Prefix><Prefix>r/13.abcdef1/</Prefix><Prefix>r/11.abcdef2/</Prefix><Prefix>other/</Prefix></L>")
    main(["discover", str(tmp_path / "page.xml"), c.base])
    assert capsys.readouterr().out.strip() == '{"short_hash":"abcdef1","number":13}'
    main(["import", c.base, "--to", str(tmp_path)])
    main(["latest", str(tmp_path), "go", "--published"])
    assert '"wanted":"go"' in capsys.readouterr().out


def test_seed(spark, rows):
    from catalith.operators.seeding import seed_records, seed_report, seeded

    data = [
        ("Go\t1.0", LINUX, "go", "m", "AA ", "s", "n", "h1"), ("GO\t1.0", LINUX, "go", "m", "bb", "s", "n", "h2"), ("Go\t1.1-rc1", MAC, "go", None, "zz", "s", "n", None),
        ("Go\t1.0", LINUX, "go_1", "m", None, "s", "n", "h"), ("none", LINUX, "x", "m", "aa", "s", "n", "h"), (None, LINUX, "x", "m", "aa", "s", "n", "h"), ("a\t", LINUX, "x", "m", "aa", "s", "n", "h"),
    ]
    schema = "version_key string, system string, attr_path string, meta_hash string, commit_hash string, store_hash string, store_name string, content_hash string"
    commits = spark.createDataFrame([("bb", DAY + datetime.timedelta(days=1)), ("aa", DAY)], "hash string, committed_at timestamp_ntz")
    records = seed_records(spark.createDataFrame(data + data[:2], schema))
    t = seeded(records, commits)
    assert rows(t["packages"]) == [(1, "Go")] and rows(t["versions"].select("version", "prerelease", "semver_major", "semver_pre")) == [("1.0", False, None, None), ("1.1-rc1", True, None, None)]
    assert rows(t["variants"].select("attr_path", "system", "commit_seq", "content_hash")) == sorted([("go", LINUX, 2, "h2"), ("go_1", LINUX, None, "h"), ("go", MAC, None, None)], key=str)
    assert t["variant_ranges"].count() == 1 and t["search_terms"].count() == 2
    assert {(r.label, r.got == r.want) for r in seed_report(records, t).collect()} == {(k, True) for k in ("packages", "versions", "variants", "variant_ranges", "search_terms")}
    empty = seeded(records.limit(0), commits)
    assert [empty[k].count() for k in ("packages", "versions", "variants", "variant_ranges")] == [0, 0, 0, 0]


def test_seed_of_a_database(spark, rows, tmp_path):
    import json

    from catalith.operators.decode import latest_package
    from catalith.operators.seeding import records_of_packages, seeded
    from catalith.sources.tables import database_table

    one = {"commit_hash": "AA", "store_hash": "s" * 32, "store_name": "go", "store_version": "1.0", "platforms": ["b", "a"], "outputs": [{"name": "out", "nar": "x"}]}
    data = [(1, "Go", "1.0", LINUX, "go", json.dumps(one)), (2, "Go", "1.1", MAC, "go", json.dumps({})), (3, "Go", "1.2", MAC, "go", "{"), (4, "", "1.2", MAC, "go", "{}"), (5, "Go", "", MAC, "go", "{}")]
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = "jdbc:derby:memory:seed;create=true"
    spark.createDataFrame(data, "id int, name string, version string, system string, attr_path string, latest_json string").write.format("jdbc").options(
        url=url, dbtable="pkg", createTableColumnTypes="name varchar(99), version varchar(99), system varchar(99), attr_path varchar(99), latest_json varchar(2000)"
    ).save()
    read = database_table(spark, url, "pkg", key="id", low=2, high=4, parts=3)
    assert read.rdd.getNumPartitions() == 2 and read.count() == 5
    records = records_of_packages(read.union(read).toDF(*(k.lower() for k in read.columns)))
    got = {r.version: r for r in records.collect()}
    assert set(got) == {"1.0", "1.1"} and got["1.0"].content_hash == latest_package(one)["content_hash"] and got["1.0"].name_key == "go" and got["1.0"].commit_hash == "aa"
    t = seeded(records, spark.createDataFrame([("aa", DAY)], "hash string, committed_at timestamp_ntz"))
    assert rows(t["variants"].select("system", "commit_seq")) == [(MAC, None), (LINUX, 1)] and t["variant_ranges"].count() == 1


def test_documents_of_status_and_older_responses(c, rows):
    import json

    doc = json.loads(render.status_document(c, ["go", "nothing"]).first()[0])
    assert doc["counts"]["variants"] == 11 and doc["oldest_commit"]["seq"] == 1 and doc["newest_commit"]["hash"] == f"{5:040x}" and [s["system"] for s in doc["systems"]] == [MAC, LINUX]
    assert doc["systems"][0]["newest"]["seq"] == 3 and [(x["name"], x.get("version"), x["systems"]) for x in doc["latest_versions"]] == [("go", "1.21.0", [LINUX]), ("nothing", None, [])]
    assert doc["last_import_at"] == "2026-01-06T00:00:00.000Z"
    old = {r.version_id: json.loads(r.document) for r in render.legacy_documents(lookup.result_rows(c, c.shown_variants())).collect()}
    assert old[5]["name"] == "Go" and old[5]["systems"][LINUX]["attr_paths"] == ["go", "go_1_22"] and old[5]["systems"][LINUX]["broken"] is True and "insecure" not in old[5]["systems"][LINUX]
    assert old[2]["platforms"] == [LINUX] and "description" not in old[2] and list(old[2]["systems"]) == [MAC, LINUX]
    names = c.packages("package_id", "name")
    assert rows(render.site_map_index(names, "o", 2))[-1] == (3, "<sitemap><loc>o/sitemaps/3.xml</loc></sitemap>") and render.site_map_index(names.limit(0), "o").count() == 1
    assert render.legacy_documents(lookup.result_rows(c, c.shown_variants()).limit(0)).count() == 0


def raw_records(spark, base, data):
    """A folder with the records and a copy of each."""
    spark.createDataFrame([*data, *data], "raw_id long, shape string, system string, payload string").coalesce(1).write.parquet(f"{base}/raw_records.parquet")
    return str(base)


def test_outputs_of_one_object(spark, rows, tmp_path):
    from catalith.plans.catalog_queries import QUERIES

    data = [
        (1, "latest", LINUX, '{"outputs": {"name": "out", "default": true}}'), (2, "latest", MAC, '{"outputs": {"name": "dev", "path": "p"}}'), (3, "latest", LINUX, '{"outputs": {"path": "p"}}'),
        (4, "latest", LINUX, '{"outputs": [{"name": "out", "default": true}, {"name": "doc"}]}'), (5, "eval", LINUX, '{"a": {"outputs": {"name": "out"}}}'),
    ]
    assert rows(QUERIES["outputs_summaries"](spark, raw_records(spark, tmp_path, data))) == [(1, ""), (2, "dev (macOS only)"), (4, "out (Linux only), doc (Linux only)")]


def test_decoded_paths_that_clean_alike(spark, rows, tmp_path):
    from catalith.plans.catalog_queries import QUERIES

    data = [(1, "eval", LINUX, '{"caf\u00e9": {"version": "1", "outputs": {}}, "cafe\u0301": {"version": "2", "outputs": {}}, " b ": {"version": "3", "outputs": {}}, "b": {"version": "3", "outputs": {}}}'), (2, "eval", LINUX, '{"b": {"outputs": {}}}')]
    got = QUERIES["decoded_packages"](spark, raw_records(spark, tmp_path, data))
    assert rows(got.select("raw_id", "attr_path", "version")) == [(1, "b", "3"), (1, "b", "3"), (1, "cafe\u0301", "1"), (1, "cafe\u0301", "2"), (2, "b", "")]


def test_many_phrases(c):
    phrases = ["python", "go", "GO", "golang", "-", "py", "task", "set.python", "python312", "nothing", ""]
    df = c.spark.createDataFrame([(p,) for p in [*phrases, "go", None]], "phrase string")
    for hits in (50, 2):
        want = sorted((p, r.ord, r.package_id, r.name, r.rank) for p in phrases for r in phrase.rank_phrase(c, p, hits=hits).collect())
        assert sorted(tuple(r) for r in phrase.rank_phrases(c, df, hits).collect()) == want and len(want) > 12
    assert phrase.rank_phrases(c, df.limit(0)).count() == 0


def test_pending_commits_of_a_whole_listing(spark, tmp_path):
    import hashlib

    hashes = [hashlib.sha1(b"%d" % n).hexdigest() for n in range(40)]
    spark.createDataFrame([(n, h, DAY, DAY) for n, h in enumerate(hashes[:30])], SCHEMAS["commits"]).coalesce(1).write.parquet(f"{tmp_path}/commits.parquet")
    listed = spark.createDataFrame([(h[: 8 + n % 4], n * 10) for n, h in enumerate(hashes)] + [("f" * 9, 5)], "short_hash string, number int")
    got = [r.number for r in status.pending_commits(Catalog(spark, str(tmp_path)), listed, 20).collect()]
    assert got == [n * 10 for n in range(30, 40)]


def test_response_texts_of_large_ids(spark, rows, tmp_path):
    """Sizes and ages of ids whose products no int holds, up to the largest."""
    from catalith.plans.catalog_queries import QUERIES

    want = [
        (1, "977 B", "977", "2 years ago"), (1680, "1.6 MiB", "1,641,360", "7 hours ago"), (1681, "1.6 MiB", "1,642,337", "in the future"), (11188, "10.4 MiB", "10,930,676", "in the future"),
        (53688, "50.0 MiB", "52,453,176", "in the future"), (2198039, "2.0 GiB", "2,147,484,103", "in the future"), (2**31 - 1, "1.9 TiB", "2,098,091,523,119", "in the future"),
    ]
    spark.createDataFrame([(i, f"m{i}", "s", "", "", "", []) for i, *_ in want] * 2, SCHEMAS["meta"]).coalesce(1).write.parquet(f"{tmp_path}/meta.parquet")
    got = QUERIES["response_texts"](spark, str(tmp_path)).select("meta_id", "size", "shown", "age")
    assert rows(got) == sorted(want, key=str)


@pytest.mark.parametrize("partitions,adaptive", [(16, True), (16, False), (3, True)])
def test_numbers_of_many_wide_rows(spark, partitions, adaptive):
    """Every row has its number, whatever adaptive execution does to the pieces."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 1_000_000 if partitions == 16 else 50_000
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("wide"), F.repeat(F.lit("x"), 60).alias("wider"))
        got = status.numbered(df, ["k"], "no")
        assert got.agg(F.count("wide"), F.count_distinct("no"), F.min("no"), F.max("no"), F.sum((F.col("no") != F.col("k") + 1).cast("int"))).first() == (n, n, 1, n, 0)
        assert status.numbered(df.limit(0), ["k"], "no").count() == 0
        twice = status.numbered(df.limit(100).union(df.limit(100)), ["k"], "no")
        assert twice.agg(F.count_distinct("no"), F.max("no")).first() == (200, 200)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
