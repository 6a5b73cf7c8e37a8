"""Event streams: windowed aggregates with watermarks, and a table kept current batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and values by window and type; works on streams and on tables.  ``ts`` may be without time zone (taken as UTC)."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if t.isStreaming:
        t = t.withWatermark("ts", late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = t.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if t.isStreaming:
        t = t.withWatermark("ts", late)
    s = t.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")


def maintain(stream: DataFrame, session, table: str, checkpoint: str):
    """Append each micro-batch to an engine table, whose materialized views follow.

    Executors write the batch as a part of the table.  The table remembers the last batch of
    each checkpoint, so a batch that is run again after a failure is not inserted twice.
    """
    from ..plans.tokens import tokens

    name = session.resolve(tokens(table))

    def each(batch: DataFrame, epoch: int) -> None:
        session.append(name, batch, mark=(checkpoint, epoch))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
