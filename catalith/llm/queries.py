"""The queries of this package over the catalog's tables, with their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm.leaks import find_leaks
from catalith.llm.split import split_corpus
from catalith.llm.tokens import Vocabulary, decode_corpus, encode_corpus
from catalith.llm.topn import top_n
from catalith.sources.tables import table

TOP, LIMIT, OVERLAP = 5, 512, 64


def p2_found(spark: SparkSession, base: str, **limits: int) -> DataFrame:
    rows = table(spark, base, "versions").select("package_id", "id", "version", "sort_key").where(F.col("sort_key").isNotNull())
    order = [F.desc("sort_key"), F.asc_nulls_last("version"), F.asc_nulls_last("id")]
    return top_n(rows, "package_id", ["id"], order, TOP, **limits)


def p2_split(spark: SparkSession, base: str) -> DataFrame:
    """The same with heavy groups from a hundred rows on, so that both ways are taken at any size of the tables."""
    return p2_found(spark, base, hot_rows=100)


P2_SQL = f"""
SELECT package_id, place, id FROM (
  SELECT package_id, id, row_number() OVER (PARTITION BY package_id ORDER BY sort_key DESC, version ASC NULLS LAST, id ASC NULLS LAST)::int AS place
  FROM (SELECT DISTINCT package_id, id, version, sort_key FROM versions WHERE sort_key IS NOT NULL AND package_id IS NOT NULL))
WHERE place <= {TOP}
"""


def p7_ids(spark: SparkSession, base: str) -> DataFrame:
    return encode_corpus(table(spark, base, "documents"), "doc_id", "text", Vocabulary.load())


def p7_lossless(spark: SparkSession, base: str) -> DataFrame:
    """The SHA-256 of the bytes that each document's ids stand for; it is that of the text."""
    vocabulary = Vocabulary.load()
    ids = encode_corpus(table(spark, base, "documents"), "doc_id", "text", vocabulary)
    return decode_corpus(ids, "doc_id", "ids", vocabulary).select("doc_id", F.sha2("data", 256).alias("digest"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return find_leaks(table(spark, base, "documents"), table(spark, base, "heldout_items"))


def p9_pieces(spark: SparkSession, base: str) -> DataFrame:
    return split_corpus(table(spark, base, "documents"), "doc_id", "text", Vocabulary.load(), limit=LIMIT, overlap=OVERLAP)


def p9_rejoined(spark: SparkSession, base: str) -> DataFrame:
    """The SHA-256 of the bytes of each document's pieces joined again, each without the overlap it begins with; it is that of the text."""
    own = F.when(F.col("piece") == 0, F.col("ids")).otherwise(F.slice("ids", OVERLAP + 1, LIMIT))
    pieces = p9_pieces(spark, base).select("doc_id", F.struct("piece", own.alias("ids")).alias("p"))
    whole = pieces.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["ids"])).alias("ids"))  # one text
    return decode_corpus(whole, "doc_id", "ids", Vocabulary.load()).select("doc_id", F.sha2("data", 256).alias("digest"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    pieces = split_corpus(table(spark, base, "documents"), "doc_id", "text", Vocabulary.load(), limit=LIMIT, overlap=OVERLAP, with_text=False)
    return pieces.where(F.col("piece") == 1).select("doc_id")


QUERIES = {"p2_found": p2_found, "p2_split": p2_split, "p7_ids": p7_ids, "p7_lossless": p7_lossless, "p8_found": p8_found, "p9_pieces": p9_pieces, "p9_rejoined": p9_rejoined, "p9_found": p9_found}
_DIGESTS = "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents"
SQL = {"p2_found": P2_SQL, "p2_split": P2_SQL, "p7_lossless": _DIGESTS, "p9_rejoined": _DIGESTS}
