"""Streams: usage logs, file changes and token chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.evaluation import saving_percent
from weftline.sources.datasets import USAGE


def usage_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(USAGE).json(folder).select(F.timestamp_millis("timestamp").alias("at"), F.col("tokensUsed").alias("tokens_used"), F.col("tokensSaved").alias("tokens_saved"), "model")


def running_usage(events: DataFrame) -> DataFrame:
    """Totals by model so far, for complete mode."""
    sums = events.groupBy("model").agg(F.count(F.lit(1)).alias("n_events"), F.sum("tokens_used").alias("tokens_used"), F.sum("tokens_saved").alias("tokens_saved"))
    return sums.withColumn("savings_percent", saving_percent(F.col("tokens_used"), F.col("tokens_saved")))


def windowed_usage(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: usage per window of event time; rows later than the watermark are dropped, as state must end."""
    return events.withWatermark("at", late).groupBy(F.window("at", size).alias("w"), "model").agg(F.count(F.lit(1)).alias("n_events"), F.sum("tokens_used").alias("tokens_used")).select("w.start", "w.end", "model", "n_events", "tokens_used")


def watch(spark: SparkSession, folder: str, changed: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Calls `changed` with (path, modified) of files new in a folder, batch by batch, until what is there now has been seen."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    rows = files.select("path", F.col("modificationTime").alias("modified"))
    return rows.writeStream.foreachBatch(lambda df, _: changed(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_chunks(chunks: DataFrame) -> DataFrame:
    """(stream_id, text, usage) of chunks(stream_id, pos, content, usage): contents in order, the last usage."""
    order = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("content", F.lit("")).alias("c"))))
    return chunks.groupBy("stream_id").agg(F.array_join(F.transform(order, lambda x: x["c"]), "").alias("text"), F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("pos"))).alias("usage"))
