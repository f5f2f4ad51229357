"""Incremental runs over arriving data; beyond the batch operators' parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.operators.documents import annotated


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """window_start, event_type, n, value_sum over event time; events later than ``late`` are dropped. Works on streams and tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value_sum"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "value_sum")


def new_clauses(stream: DataFrame, key: str = "doc_id", when: str = "fetched_at", late: str = "7 days", text: str = "text") -> DataFrame:
    """Annotated clause texts of a stream, re-delivered ones within ``late`` once."""
    once = stream.withWatermark(when, late).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else stream.dropDuplicates([key])
    return annotated(once, text)


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that has arrived, written to Parquet; ``complete`` results replace what was there."""
    if mode == "complete":
        query = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint)
    else:
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def parquet_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder as a stream, with the table's schema."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
