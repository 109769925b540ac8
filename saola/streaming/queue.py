"""The request queue as a stream: pending requests in, predictions out, a log beside them.

Offsets and the checkpoint replace polling and deleting; each micro-batch is corrected by the same function as a
table, inside foreachBatch, because correction holds joins and top-1 choices that streams don't allow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.io import QUEUE_SCHEMA

Correct = Callable[[DataFrame], DataFrame]


def read_queue(spark: SparkSession, directory: str, files_at_once: int = 16) -> DataFrame:
    """Stream of queued requests from Parquet files; a round takes at most files_at_once files."""
    return spark.readStream.schema(QUEUE_SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(directory)


def pending(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("prediction").isNull())


def serve(requests: DataFrame, correct: Correct, out: str, checkpoint: str, log: str | None = None) -> StreamingQuery:
    """Corrects pending requests and appends (id, content, prediction, finish) to out; correct maps rows with id and
    content to rows with id and prediction. A batch that runs again overwrites its own folder, so a request is
    answered once however often executors are lost."""

    def run(batch: DataFrame, number: int) -> None:
        # a request that came more than once in a batch is answered once
        todo = pending(batch).groupBy("id").agg(F.min("content").alias("content"), F.min("client_id").alias("client_id"), F.min("queued_at").alias("queued_at"))
        done = todo.join(correct(todo.select("id", "content")), "id").select("id", "content", "prediction", F.lit(1).alias("finish"), "client_id", "queued_at")
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if log:
            rows = done.select(F.col("id").cast("bigint").alias("log_id"), "client_id", F.col("content").alias("input_text"), F.col("prediction").alias("predict_text"), F.col("queued_at").alias("logged_at"), F.current_timestamp().alias("received_at"))
            rows.withColumn("elapsed_time", F.unix_micros("received_at").cast("double") / 1e6 - F.unix_micros("logged_at") / 1e6).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def push(requests: DataFrame, directory: str) -> None:
    """Puts requests (id, content, client_id, queued_at) into the queue: one append, pending."""
    rows = requests.select("id", "content", F.lit(None).cast("string").alias("prediction"), F.lit(0).alias("finish"), "client_id", "queued_at")
    rows.write.mode("append").parquet(directory)


def remaining(queue: DataFrame, answered: DataFrame) -> DataFrame:
    """The queue without the requests that were answered or taken back; a table without rows clears nothing."""
    return queue.join(answered.select("id").distinct(), "id", "left_anti")


def snapshot(queue: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, content, prediction, finish): every request once, finished where there is an answer."""
    asked = queue.groupBy("id").agg(F.min("content").alias("content"), F.max("prediction").alias("before"))
    got = answers.groupBy("id").agg(F.max(F.struct(F.col("finish"), "prediction")).alias("a"))
    joined = asked.join(got, "id", "left")
    text = F.coalesce("a.prediction", "before")
    return joined.select("id", "content", text.alias("prediction"), F.when(F.col("a").isNotNull() | F.col("before").isNotNull(), 1).otherwise(0).alias("finish"))


def response(results: DataFrame, request_id: str) -> DataFrame:
    """The answer to one request, empty while there is none."""
    return results.where(F.col("id") == request_id).select("id", "prediction")


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Log entries per client and time window with a watermark; works on streams and tables."""
    return (
        events.withWatermark("logged_at", late).groupBy(F.window("logged_at", width).alias("w"), "client_id").agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), "client_id", "n")
    )
