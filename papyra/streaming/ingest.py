"""Streams: raw files as they arrive, newest progress, and windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.stats import newest
from ..sources.store import table_or_empty, upload_rows

PROGRESS = "document_id string, payload string, updated_at timestamp"


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of documents rows, one for each file that appears in a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1000).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return upload_rows(files.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension")))


def append_uploads(uploads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return uploads.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def keep_newest(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest progress row of each document in ``path``.

    Two folders take turns, so a batch never overwrites what it reads, and a
    batch that is run again gives the same table."""
    spark = updates.sparkSession

    def upsert(batch: DataFrame, number: int) -> None:
        old = table_or_empty(spark, f"{path}/{(number + 1) % 2}", PROGRESS)
        latest = newest(batch.unionByName(old), "document_id", "updated_at")
        latest.write.mode("overwrite").parquet(f"{path}/{number % 2}")

    return updates.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Where progress is looked for, the first that knows a document first.
PROGRESS_SOURCES = ("memory", "extract", "md", "tree")
PROGRESS_OUT = "document_id string, source string, payload string, updated_at timestamp, expired boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ProgressState(StatefulProcessor):
    """A document's newest progress from each source, in keyed state.

    Each batch that tells something new gives a row: the payload of the first source
    that knows the document.  Of a source the newest update counts, of equal times the
    larger payload, so a batch that is run again changes nothing.  A document whose last
    update lies ``keep_ms`` behind the stream's time is forgotten, with a row that says so."""

    def __init__(self, keep_ms: int, sources: tuple[str, ...] = PROGRESS_SOURCES) -> None:
        self.keep_ms, self.sources = keep_ms, sources

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getMapState("latest", "source string", "payload string, updated_at timestamp")

    def _row(self, key: str, expired: bool) -> pd.DataFrame:
        known = {k[0]: v for k, v in self.latest.iterator()}
        source = next((s for s in self.sources if s in known), None)
        if source is None:
            return pd.DataFrame()
        return pd.DataFrame([{"document_id": key, "source": source, "payload": known[source][0], "updated_at": known[source][1], "expired": expired}])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        changed = False
        for part in rows:
            for source, payload, at in zip(part["source"], part["payload"], part["updated_at"]):
                if source not in self.sources or pd.isna(at):
                    continue
                old = self.latest.getValue((source,)) if self.latest.containsKey((source,)) else None
                if old is None or (pd.Timestamp(at).tz_localize(None), payload) > (pd.Timestamp(old[1]).tz_localize(None), old[0]):
                    self.latest.updateValue((source,), (payload, at.to_pydatetime()))
                    changed = True
        if changed:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            last = max(pd.Timestamp(v[1]) for _, v in self.latest.iterator())
            self.handle.registerTimer(int(last.timestamp() * 1000) + self.keep_ms)
            yield self._row(key[0], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield self._row(key[0], True)
        self.latest.clear()


def tracked_progress(updates: DataFrame, keep_ms: int = 24 * 3_600_000, late: str = "1 day", sources: tuple[str, ...] = PROGRESS_SOURCES) -> DataFrame:
    """A stream of (document_id, source, payload, updated_at, expired) rows from ``updates``
    (document_id, source, payload, updated_at): after each batch, what is known of the
    documents that it told something new of.

    State is kept per document and changed in place, whatever the number of documents
    so far.  Updates of unknown sources, without a document or a time, and those
    later than ``late`` are ignored.  The session's state store has to be RocksDB, which use_keyed_state() sets."""
    rows = updates.select("document_id", "source", F.coalesce("payload", F.lit("")).alias("payload"), F.col("updated_at").cast("timestamp").alias("updated_at"))
    rows = rows.where("document_id is not null and updated_at is not null").withWatermark("updated_at", late)
    return rows.groupBy("document_id").transformWithStateInPandas(statefulProcessor=ProgressState(keep_ms, sources), outputStructType=PROGRESS_OUT, outputMode="Update", timeMode="EventTime")


def use_keyed_state(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB, as keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of events (ts, event_type, value), on a stream
    or a table; rows later than ``late`` are ignored on a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
