"""Structured Streaming: ingest, daily counts, answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def table_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 8) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def daily_counts(events: DataFrame, time: str, late: str = "2 days") -> DataFrame:
    """(day, n, avg_value): tumbling days by event time; rows later than ``late`` are dropped, state with them."""
    at = events.withColumn("_t", F.col(time).cast("timestamp"))
    return at.withWatermark("_t", late).groupBy(F.window("_t", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 3).alias("avg_value")).select(F.to_date(F.col("w.start")).alias("day"), "n", "avg_value")


def fresh_chunks(chunks: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """A chunk once: repeats within the watermark are dropped, so state stays bounded."""
    return chunks.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key]).drop("_t")


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, batch by batch, exactly once per checkpoint."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def append_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Idempotent parquet sink: a batch that runs again replaces its own folder."""

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def answer_events(answers: DataFrame) -> DataFrame:
    """Typed events of a batch of answers: start, context, end, in order."""
    kinds = F.array(F.struct(F.lit(0).alias("seq"), F.lit("start").alias("event")), F.struct(F.lit(1), F.lit("context")), F.struct(F.lit(2), F.lit("end")))
    rows = answers.withColumn("e", F.explode(kinds))
    data = F.when(F.col("e.event") == "context", F.to_json(F.struct("citations"))).when(F.col("e.event") == "end", F.to_json(F.struct("kind", "confidence"))).otherwise(F.to_json(F.struct("question")))
    return rows.select("question_id", "e.seq", "e.event", data.alias("data"))


def answering_sink(answer: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """Answers a batch of questions and appends the event rows."""

    def write(df: DataFrame, epoch: int) -> None:
        answer_events(answer(df)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write
