"""Incremental intake: deduplicated commits, windowed counts, sessions and expiry over a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def commit_stream(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """New files under ``path`` as a stream, with the time as a timestamp; the schema is that of the files there.

    The path is given as a pattern, which may name one file as well as a folder.
    """
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(pattern).withColumn(time, F.col(time).cast("timestamp"))


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all there is, with its offsets and state under ``folder``, and reads what it wrote.

    A later call with the same folder takes only what is new. ``append`` adds
    files; ``complete`` replaces the result after each batch; ``update`` takes
    all there is as one batch and adds a folder for it, as streams with timers
    by the clock never rest.
    """
    spark = stream.sparkSession
    out, at = f"{folder}/out", f"{folder}/offsets"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", at)
    writer = writer.trigger(once=True) if mode == "update" else writer.trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    elif mode == "update":  # a batch that is repeated replaces its folder
        query = writer.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_told(stream: DataFrame, folder: str) -> DataFrame:
    """Runs the stream as :func:`drain` does, and returns its progress, rows (batch, rows), in place of what it wrote."""
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start()
    query.awaitTermination()
    return stream.sparkSession.createDataFrame([(x["batch"], x["rows"]) for x in progress(query)], "batch long, rows long")


def new_commits(stream: DataFrame, key: str = "event_id") -> DataFrame:
    """Each commit once, by a state of keys seen."""
    return stream.dropDuplicates([key])


def recent_commits(stream: DataFrame, key: str = "event_id", time: str = "ts", ttl: str = "24 hours") -> DataFrame:
    """Each commit once within ``ttl``; older keys leave the state."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


def sliding_counts(stream: DataFrame, key: str, time: str = "ts", width: str = "14 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(key, F.window(time, width, step).alias("w")).agg(F.count(F.lit(1)).alias("commits")).select(key, F.col("w.start").alias("window_start"), "commits")


def bursts(stream: DataFrame, key: str, time: str = "ts", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of commits that are at most ``gap`` apart."""
    return stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("commits")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "commits")


class Progress(StreamingQueryListener):
    """Hands each batch's progress, as a dict of id, batch and rows, to a callback."""

    def __init__(self, tell: Callable[[dict], None]):
        self._tell = tell

    def onQueryStarted(self, event):  # noqa: N802
        self._tell({"id": str(event.id), "state": "started"})

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self._tell({"id": str(p.id), "state": "progress", "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event):  # noqa: N802
        self._tell({"id": str(event.id), "state": "idle"})

    def onQueryTerminated(self, event):  # noqa: N802
        self._tell({"id": str(event.id), "state": "ended", "error": event.exception})


def progress(query) -> list[dict]:
    """What a finished or running query tells of its batches: rows (batch, rows) of the batches that had any."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"]} for p in query.recentProgress if p["numInputRows"]]
