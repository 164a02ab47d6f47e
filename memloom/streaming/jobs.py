"""Streams that keep the store up to date, and what is measured of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators import ranks
from memloom.operators.store import Store
from memloom.sources.scratch import scratch


def keep_up(stream: DataFrame, store: Store, table: str, then: Callable[[Store], None] | None = None) -> None:
    """All that is there now is upserted into the store, micro-batch by micro-batch; ``then`` runs after each, as a
    consolidation does. A batch that is repeated after a failure writes one more version of the same rows, which reads
    the same. Run it on a schedule."""

    def write(batch: DataFrame, number: int) -> None:
        store.upsert(table, batch)
        if then is not None:
            then(store)

    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", scratch(stream.sparkSession, "keep-up")).trigger(availableNow=True).start()
    run.awaitTermination()


def snapshot(rows: DataFrame, kind: str, value: str, order: list[str], *, most: int = 10_000, kept: int = 5_000) -> DataFrame:
    """(kind, n, mean, p50, p95, p99) of measured values; of a kind with more than ``most`` only the last ``kept``
    count."""
    numbered = ranks.numbered(rows.select(kind, value, *order), order, group=[kind])
    sizes = numbered.groupBy(kind).agg(F.count("*").alias("all_"))
    last = numbered.join(F.broadcast(sizes), kind).where((F.col("all_") <= most) | (F.col("seq") > F.col("all_") - kept))  # one row a kind
    at = lambda q: F.least(F.col("n"), F.floor(F.col("n") * F.lit(q)) + 1)
    return ranks.order_statistics(last, value, {"p50": at(0.5), "p95": at(0.95), "p99": at(0.99)}, group=[kind])


def sessions(rows: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """(key, start, n): events no further apart than ``gap``."""
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")
