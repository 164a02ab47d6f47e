"""Texts and files as drawers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import text
from memloom.operators.store import Store


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, text) of each file below ``path`` whose name fits ``pattern``."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def paragraphs_of_files(spark: SparkSession, path: str, pattern: str = "*.{md,txt,org}") -> DataFrame:
    """(path, paragraph) of each paragraph of 20 characters or more."""
    return whole_files(spark, path, pattern).select("path", F.explode(text.paragraphs(F.col("text"))).alias("paragraph"))


def is_fast(source: Column, flag: Column | None = None) -> Column:
    """Whether a text takes the short way: as the flag says, else if its source is one of the bulk sources."""
    by_source = source.isin(*text.BULK_SOURCES)
    return by_source if flag is None else F.coalesce(flag, by_source)


def bulk(store: Store, rows: DataFrame, *, source: str, at: Column, scope: dict[str, str] | None = None) -> DataFrame:
    """Texts (text) as drawers of one source and scope, without edges. The new ones are returned."""
    pairs = F.create_map(*[F.lit(x) for kv in (scope or {"source": source}).items() for x in kv])
    return store.insert_drawers(rows.where("text IS NOT NULL").select("text", F.lit(source).alias("source"), pairs.alias("scope"), at.alias("created")))
