"""Incremental scans as a stream: changed sources in, a fresh report out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from taproot.plans.scan import Report, scan
from taproot.sources.cache import FactCache


def latest(changes: DataFrame) -> DataFrame:
    """(path, text) of the last change of each path; a null text is a deletion."""
    last = changes.groupBy("path").agg(F.max_by("text", "version").alias("text"), F.max("version").alias("version"))
    return last.where("text is not null").select("path", "text")


def watch(changes: DataFrame, table: str, entries: DataFrame, cache: FactCache, checkpoint: str, done: Callable[[Report, int], None]) -> StreamingQuery:
    """Appends a stream of (path, text, version) to the Parquet folder ``table``; scans after each batch.

    Only sources whose content changed are read again; the graph is computed anew,
    as liveness is not local.  A batch that is run twice is written to its own
    folder, over what it left the first time.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark: SparkSession = rows.sparkSession
        rows.select("path", "text", "version").write.mode("overwrite").parquet(f"{table}/batch={number}")
        done(scan(latest(spark.read.parquet(table)), entries, cache), number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
