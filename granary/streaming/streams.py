"""Stream forms of log ingest, activity feed and audit landing."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from granary.operators.audit import SILVER_KEYS, silver_audit
from granary.operators.gold import LOG_KEYS, LOG_LAYOUT, parsed_rows
from granary.operators.ingest import land_split
from granary.operators.tables import Layout, Table
from granary.sources.readers import AUDIT_EVENT, BROKEN, split_events


def _merge_batches(rows: DataFrame, table: Table, name: str, checkpoint: str, make: Callable[[DataFrame], DataFrame], keys: list[str]) -> StreamingQuery:
    """Merges each micro-batch once: its number is part of the table's version, so one that is replayed after a failure is skipped."""
    def merge(batch: DataFrame, number: int) -> None:
        table.merge(make(batch), keys, "_row_hash", batch=(name, number))

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()


def stream_logs(spark: SparkSession, path: str, schema: StructType, target: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """New log files, parsed, once for each (id, time), merged into the target's days. Ids are kept for the watermark's day. The stream's
    name (its checkpoint, if none is given) tells its batches from those of others."""
    rows = spark.readStream.schema(schema).parquet(path).withColumn("Timestamp", F.col("Timestamp").cast("timestamp"))
    once = rows.withWatermark("Timestamp", "1 day").dropDuplicatesWithinWatermark(["OperationId", "Timestamp"])
    return _merge_batches(once, Table(spark, target, LOG_LAYOUT), name or checkpoint, checkpoint, parsed_rows, LOG_KEYS)


def feed(rows: DataFrame, size: str = "15 minutes") -> DataFrame:
    """Operations of each tumbling window; the same on a batch and on a stream."""
    return rows.groupBy(F.window("Timestamp", size).alias("w"), "OperationName").agg(F.count("*").alias("operations")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "OperationName", "operations"
    )


def stream_feed(spark: SparkSession, path: str, schema: StructType, size: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Rows later than the watermark are dropped here; the batch form counts them."""
    rows = spark.readStream.schema(schema).parquet(path).withColumn("Timestamp", F.col("Timestamp").cast("timestamp"))
    return feed(rows.withWatermark("Timestamp", late), size)


def stream_audit_blobs(spark: SparkSession, path: str, target: str, quarantine: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """New files of audit events (JSON arrays) into the days of the silver table; broken ones into the quarantine table, and the stream goes on."""
    rows = spark.readStream.schema(f"{AUDIT_EVENT}, {BROKEN} string").option("multiLine", True).json(path).withColumn("file_name", F.col("_metadata.file_path"))
    silver, broken, stream = Table(spark, target, Layout(("log_date",))), Table(spark, quarantine), name or checkpoint

    def land(batch: DataFrame, number: int) -> None:
        land_split(*split_events(batch), silver, broken, (stream, number))

    return rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).queryName(stream).trigger(availableNow=True).start()


class LateRows(StreamingQueryListener):
    """Counts the rows that streams drop because they come after the watermark: query, batch, rows, at. `flush` writes them to a table; a listener
    itself must not run jobs, as it holds up the events of all streams."""

    def __init__(self, table: Table):
        self.table, self._seen, self._guard = table, [], threading.Lock()

    def onQueryStarted(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if dropped := sum(x.numRowsDroppedByWatermark for x in p.stateOperators):
            with self._guard:
                self._seen.append((p.name or str(p.id), p.batchId, dropped, dt.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))))

    def flush(self) -> int:
        """Appends what has been seen; the number of late rows in it."""
        with self._guard:
            rows, self._seen = self._seen, []
        if rows:
            self.table.append(self.table.spark.createDataFrame(rows, "query string, batch long, rows long, at timestamp"))
        return sum(r[2] for r in rows)


def stream_audit(spark: SparkSession, path: str, schema: StructType, target: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """New audit files into the days of the silver table."""
    rows = spark.readStream.schema(schema).parquet(path)
    return _merge_batches(rows, Table(spark, target, Layout(("log_date",))), name or checkpoint, checkpoint, silver_audit, SILVER_KEYS)
