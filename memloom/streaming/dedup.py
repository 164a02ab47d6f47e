"""Incremental deduplication as a stream: state is the text hashes seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions import text
from memloom.sources.scratch import scratch


def distinct_texts(stream: DataFrame, column: str = "text") -> DataFrame:
    """h: the hash of each normalised text, once. State grows with the number of distinct texts, in the state
    store's files; null texts go."""
    return stream.where(F.col(column).isNotNull()).select(text.text_hash(F.col(column)).alias("h")).dropDuplicates(["h"])


def drain(stream: DataFrame, name: str) -> DataFrame:
    """All that is there now goes through the stream into the shared folder, and is read again."""
    spark = stream.sparkSession
    at = scratch(spark, name)
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}-state").option("path", at).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(at)
