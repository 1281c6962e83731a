"""Structured Streaming twins of the polling loops: files in, keyed state out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators import upserts
from millrace.session import remove


def read_files(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files: int = 1) -> DataFrame:
    """A file stream, a few files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def drain(stream: DataFrame, sink, checkpoint: str) -> None:
    """Run what is there batch by batch, then stop; ``sink(batch, number)`` must be safe to repeat."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_stream(spark: SparkSession, stream: DataFrame, table: str, checkpoint: str) -> None:
    """Apply each batch of (id, seq, payload, status) to the state under ``table``: version n + 1 is written from version n, and version n - 1 removed.

    The version before the last stays, so that a batch can be repeated. A batch
    rewrites the state; where that is large against the batches, keep it in a table
    format with MERGE instead.
    """
    empty = "id string, payload string, status string, last_scrape timestamp_ntz"

    def sink(batch: DataFrame, n: int) -> None:
        now = spark.read.parquet(f"{table}/v{n}") if n else spark.createDataFrame([], empty)
        upserts.upsert(now, batch).write.mode("overwrite").parquet(f"{table}/v{n + 1}")
        if n > 1:
            remove(spark, f"{table}/v{n - 1}")

    drain(stream, sink, checkpoint)


def tumbling(stream: DataFrame, width: str, late: str) -> DataFrame:
    """Count and maximum of value by event type in windows of event time; rows later than ``late`` are dropped."""
    by = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return by.agg(F.count("*").alias("n"), F.max("value").alias("top")).select(F.col("window.start").alias("start"), "event_type", "n", "top")


def deduplicated(stream: DataFrame, key: list[str], late: str) -> DataFrame:
    """Replays of a key within the watermark are dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def discover(spark: SparkSession, stream: DataFrame, table: str, checkpoint: str) -> None:
    """Append the ids of each batch that aren't in ``table`` yet, as pending; a batch repeated writes its own folder again."""

    def sink(batch: DataFrame, n: int) -> None:
        new = batch.select("id").distinct()
        if n:
            known = spark.read.schema("id string, batch int").parquet(table).where(F.col("batch") < n)
            new = new.join(known.select("id"), "id", "left_anti")
        new.withColumn("status", F.lit(upserts.PENDING)).write.mode("overwrite").parquet(f"{table}/batch={n}")

    drain(stream, sink, checkpoint)


def latest_windows(stream: DataFrame, width: str, late: str, out: str, checkpoint: str) -> None:
    """Windows of event time that change in a batch, written to ``out``/batch=n; the state holds windows within the watermark only."""

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    rows = tumbling(stream, width, late)
    rows.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
