"""A segmented table: immutable batches, tombstones, compaction; and event-time windows.

Layout under one folder: ``segments/segment_id=N/`` and ``tombstones/batch=N/``.
A batch is written once under its number; writing it again replaces it, so a
retried micro-batch leaves the table as one run would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SegmentedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def append(self, batch: DataFrame, segment_id: int) -> None:
        """Writes a batch (path, and any other columns) as a segment."""
        batch.write.mode("overwrite").parquet(f"{self.root}/segments/segment_id={segment_id}")

    def tombstone(self, paths: DataFrame, upto_segment: int) -> None:
        """Marks paths as deleted in all segments up to one; a later segment may bring them back."""
        paths.select("path").distinct().withColumn("upto", F.lit(upto_segment).cast("long")).write.mode("overwrite").parquet(f"{self.root}/tombstones/batch={upto_segment}")

    def live(self) -> DataFrame:
        """Rows of the newest segment of each path that no tombstone covers."""
        rows = self.spark.read.parquet(f"{self.root}/segments").withColumn("segment_id", F.col("segment_id").cast("long"))
        newest = rows.groupBy("path").agg(F.max("segment_id").alias("_newest"))
        out = rows.join(newest, "path").filter("segment_id = _newest").drop("_newest")
        if self._exists(f"{self.root}/tombstones"):
            t = self.spark.read.parquet(f"{self.root}/tombstones").groupBy("path").agg(F.max("upto").alias("_upto"))
            out = out.join(t, "path", "left").filter("_upto IS NULL OR segment_id > _upto").drop("_upto")
        return out

    def compact(self, into: str) -> SegmentedTable:
        """Writes the live rows as one segment of a new table."""
        new = SegmentedTable(self.spark, into)
        new.append(self.live().drop("segment_id"), 0)
        return new

    def ingest(self, stream: DataFrame, checkpoint: str):
        """Starts a query that appends each micro-batch of a stream as a segment, exactly once."""
        first = self.next_segment()

        def write(batch: DataFrame, number: int) -> None:
            self.append(batch, first + number)

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def next_segment(self) -> int:
        if not self._exists(f"{self.root}/segments"):
            return 0
        p, fs = self._fs(f"{self.root}/segments")
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([int(n.split("=")[1]) + 1 for n in names if n.startswith("segment_id=")], default=0)


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """(start, key, n, total): tumbling event-time windows with a watermark; batch or stream."""
    w = events.withWatermark(ts, late) if events.isStreaming else events
    return w.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, start, end, n): runs of events with gaps below ``gap``; batch or stream."""
    w = events.withWatermark(ts, late) if events.isStreaming else events
    return w.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events without repeats of their keys; on a stream, repeats within the watermark."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)
