"""Queries from the command line: ``python -m catalith.cli COMMAND FOLDER ...``; rows are printed as JSON lines, or written as Parquet with --to.

``import CATALOG ARCHIVE ...`` imports the archives of one evaluation, ``import CATALOG`` what is staged in the catalog's folder.
``discover LISTING CATALOG`` reads saved pages of a release listing and names the oldest releases that the catalog lacks.
"""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.paths import listed_prefixes
from catalith.operators import history, lookup, merge, phrase, status
from catalith.operators.decode import archive_packages, decode_packages, read_archives
from catalith.operators.importing import backfilled, changes, current, evaluation_of, imported, publish
from catalith.sources.catalog import Catalog


def answer(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.command == "archives":
        return archive_packages(read_archives(spark, args.words), args.hidden_field)
    c = current(spark, args.folder) if args.published else Catalog(spark, args.folder)
    words = args.words
    if args.command == "resolve":
        return lookup.resolve(c, words[0], words[1] if len(words) > 1 else "latest", args.system).drop("sort_key")
    if args.command == "list":
        return lookup.versions_by_name(c, words[0], args.system).drop("sort_key")
    if args.command == "search":
        return phrase.search_phrase(c, " ".join(words)).drop("sort_key")
    if args.command == "latest":
        return lookup.latest_for(c, words) if words else lookup.latest_versions(c, system=args.system)
    if args.command == "status":
        return status.system_status(c)
    if args.command == "counts":
        return status.row_counts(c)
    if args.command == "incomplete":
        return status.incomplete_commits(c, words)
    if args.command == "backfill-list":
        return status.batches(status.incomplete_commits(c, words), ["seq"], args.size)
    if args.command in ("backfill", "import"):
        now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
        if args.command == "import" and words and not (args.commit and args.date and args.system):
            raise SystemExit("archives need --commit, --date and --system")
        try:
            if args.command == "backfill":
                tables = backfilled(c, c.raw("stage_backfill_ranges"), history.dated_contents(c))
            elif words:
                commits = spark.sql("select :hash as hash, cast(:at as timestamp_ntz) as committed_at", args={"hash": args.commit, "at": args.date})
                evals, contents, metas = evaluation_of(archive_packages(read_archives(spark, words), args.hidden_field), args.system, args.commit)
                tables = imported(c, evals, contents, now, metas, commits)
            else:
                tables = imported(c, merge.newest_evaluations(c), c.raw("stage_variants"), now)
            if args.dry_run:
                return changes(c, tables)
            return spark.createDataFrame([(publish(tables, args.to or args.folder, args.number),)], "folder string")
        except ValueError as e:
            raise SystemExit(str(e)) from e
    if args.command == "discover":
        releases = spark.read.text(args.folder, wholetext=True).select(F.explode(listed_prefixes(F.col("value"))).alias("prefix"))
        parts = F.regexp_extract("prefix", r"([0-9]+)\.([0-9a-f]+)/?$", 1).try_cast("int").alias("number"), F.regexp_extract("prefix", r"([0-9]+)\.([0-9a-f]+)/?$", 2).alias("short_hash")
        found = releases.select(*parts).where(F.col("number").isNotNull()).distinct()
        return status.pending_commits(Catalog(spark, words[0]), found.select("short_hash", "number"), args.size)
    return decode_packages(c.raw("raw_records"), args.hidden_field)


COMMANDS = ["resolve", "list", "search", "latest", "status", "counts", "incomplete", "backfill-list", "backfill", "import", "discover", "decode", "archives"]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("folder")
    parser.add_argument("words", nargs="*")
    parser.add_argument("--system")
    parser.add_argument("--size", type=int, default=10, help="commits of a batch, releases of a discovery")
    parser.add_argument("--number", type=int, help="of the catalog that is published, the next one if missing")
    parser.add_argument("--dry-run", action="store_true", help="import and backfill: print what would change and write nothing")
    parser.add_argument("--published", action="store_true", help="the folder has published imports; take the last")
    parser.add_argument("--commit", help="of the archives that are imported")
    parser.add_argument("--date", help="when the commit was made, UTC")
    parser.add_argument("--hidden-field", help="of meta, which holds versions that names don't")
    parser.add_argument("--to", help="write Parquet there instead of printing")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = answer(spark, args)
    if args.to and args.command not in ("import", "backfill"):
        df.write.mode("overwrite").parquet(args.to)
    else:
        for line in df.toJSON().toLocalIterator():
            print(line)


if __name__ == "__main__":
    main()
