"""Event-time windows and stateful deduplication over streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(events: DataFrame, time_col: str, late: str) -> DataFrame:
    """Streams need a time-zoned event time and a watermark."""
    if not events.isStreaming:
        return events
    return events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "2 days", time_col: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts and sums per key and window; streams drop what comes later than ``late``."""
    x = _timed(events, time_col, late)
    return (
        x.groupBy(F.window(time_col, width).alias("w"), key)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), key, "n", "total")
    )


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days", time_col: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions per key: runs of events with less than ``gap`` between them."""
    x = _timed(events, time_col, late)
    return (
        x.groupBy(F.session_window(time_col, gap).alias("w"), key)
        .agg(F.count("*").alias("n"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def first_seen(events: DataFrame, keys: list[str], time_col: str = "ts", late: str = "2 days") -> DataFrame:
    """The first row of each key; a stream forgets keys that are older than ``late``."""
    if events.isStreaming:
        return _timed(events, time_col, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def run_once(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> None:
    """Process everything that is there, exactly once across restarts, into parquet below ``out``."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the parquet files at ``path``, a folder or a single file."""
    table = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(table.schema)
    if any(f.rstrip("/").endswith(f"/{name}") for f in table.inputFiles()):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def follow_spends(stream_inputs: DataFrame, watched: DataFrame) -> DataFrame:
    """A monitor: spends (txid, prev_txid, prev_vout) of watched outpoints (txid, vout), as they arrive."""
    return stream_inputs.join(
        watched.select(F.col("txid").alias("prev_txid"), F.col("vout").alias("prev_vout")), ["prev_txid", "prev_vout"]
    )
