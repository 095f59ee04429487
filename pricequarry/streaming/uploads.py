"""Incremental feeds: uploads as they come in, and windowed aggregates over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def incoming(spark: SparkSession, path: str, schema: str, form: str = "parquet", files_at_once: int = 1) -> DataFrame:
    """Files in the order of their times, so many in each batch: the queue of uploads."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_at_once).load(path)


def process(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs ``each`` on every batch with its number. A batch that runs again after a failure has the same number, by which ``each`` can tell."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def with_words(stream: DataFrame, spark: SparkSession, words_path: str, key: str) -> DataFrame:
    """A stream with a dictionary that is read anew for every batch."""
    return stream.join(spark.read.parquet(words_path), key, "left")


def _timed(stream: DataFrame, at: str) -> DataFrame:
    """Watermarks need times with a zone: those without one count in the session's."""
    return stream.withColumn(at, F.col(at).cast("timestamp")) if stream.schema[at].dataType.typeName() == "timestamp_ntz" else stream


def tumbling(stream: DataFrame, at: str, width: str, late: str, by: str, value: str) -> DataFrame:
    """Count and mean for each window and key; events later than ``late`` are left out."""
    return _timed(stream, at).withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), by, "n", "mean")


def sliding(stream: DataFrame, at: str, width: str, step: str, late: str, by: str, value: str) -> DataFrame:
    return _timed(stream, at).withWatermark(at, late).groupBy(F.window(at, width, step).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), by, "n", "mean")


def sessions(stream: DataFrame, at: str, gap: str, late: str, by: str) -> DataFrame:
    """Runs of a key's events no further apart than ``gap``."""
    return _timed(stream, at).withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def once_within(stream: DataFrame, at: str, late: str, *key: str) -> DataFrame:
    """Events without repeats of a key within the time that late ones are waited for."""
    return _timed(stream, at).withWatermark(at, late).dropDuplicatesWithinWatermark(list(key))


def progress(query: StreamingQuery) -> dict:
    """What a status page shows of a running query."""
    last = query.lastProgress
    return {"active": query.isActive, "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0, "message": query.status["message"]}
