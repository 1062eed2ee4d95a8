"""Loading tables: explicit columns only, so scans read what a query needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day as of which reports and bonuses are taken.
AS_OF = "2024-06-30"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; timestamps without zone become timestamps."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def published() -> Column:
    """Stand-in for a date that the test tables lack: days of 2022 to 2024 by doc_id."""
    return F.date_add(F.lit("2022-01-01").cast("date"), F.pmod("doc_id", F.lit(900)).cast("int"))


def authority() -> Column:
    """Stand-in for a source's authority: by the last digit of its name."""
    digit = F.substring("source", -1, 1)
    return F.when(digit.isin(*"01234"), "official").when(digit.isin(*"567"), "official_secondary").otherwise("curated")


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as versions.  Stand-ins for columns that the test tables lack: title is the first 80 characters of the
    text, uri its digest (copies share one), kind by its length, published and authority as above; lang is the scope."""
    docs = table(spark, folder, "documents")
    kind = F.when(F.col("n_chars") < 400, "attachment").otherwise("html")
    return docs.select("doc_id", "source", "lang", F.substring("text", 1, 80).alias("title"), F.col("text").alias("body"), F.md5("text").alias("uri"), kind.alias("kind"), published().alias("published"), authority().alias("authority"))


def excluded(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id of what quality control excludes; documents without a label are accepted."""
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return labels.where("quality = 0 OR toxic = 1").select("doc_id")


def current(rows: DataFrame, spark: SparkSession, folder: str, scopes: tuple[str, ...] = ("en", "fr")) -> DataFrame:
    """The security triple on rows with doc_id and lang: of the given scopes, not excluded."""
    return rows.where(F.col("lang").isin(*scopes)).join(excluded(spark, folder), "doc_id", "left_anti")


def current_documents(spark: SparkSession, folder: str, scopes: tuple[str, ...] = ("en", "fr")) -> DataFrame:
    return current(versions(spark, folder), spark, folder, scopes)


#: The same in SQL: excluded documents, and the view of versions.
SQL_EXCLUDED = "(SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 0 OR max(toxic) = 1)"
SQL_CURRENT = f"lang IN ('en', 'fr') AND doc_id NOT IN {SQL_EXCLUDED}"
SQL_VERSIONS = """(SELECT doc_id, source, lang, substr(text, 1, 80) AS title, text AS body, md5(text) AS uri,
  CASE WHEN n_chars < 400 THEN 'attachment' ELSE 'html' END AS kind, (DATE '2022-01-01' + (doc_id % 900)::INT) AS published,
  CASE WHEN right(source, 1) IN ('0', '1', '2', '3', '4') THEN 'official' WHEN right(source, 1) IN ('5', '6', '7') THEN 'official_secondary' ELSE 'curated' END AS authority FROM documents)"""
