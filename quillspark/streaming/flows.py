"""Questions and answers that keep arriving: micro-batches, request matching, expiring caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def answered(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, at_once: bool = True) -> StreamingQuery:
    """Each micro-batch of questions through ``answer``, appended to ``path`` under its batch id, so a batch that is run again replaces itself."""

    def batch(df: DataFrame, batch_id: int) -> None:
        answer(df).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if at_once else writer.trigger(processingTime="15 seconds")).start()


def matched(requests: DataFrame, replies: DataFrame, within: str = "600 seconds") -> DataFrame:
    """Requests (session, id, asked_at, ...) with their reply (session, id, replied_at, ...) if it came in time."""
    a = requests.withWatermark("asked_at", within).alias("a")
    b = replies.withWatermark("replied_at", within).alias("b")
    on = F.expr(f"a.session = b.session AND a.id = b.id AND b.replied_at >= a.asked_at AND b.replied_at <= a.asked_at + INTERVAL {within}")
    return a.join(b, on).select("a.session", "a.id", "a.asked_at", "b.replied_at", *[F.col(f"b.{c}") for c in replies.columns if c not in ("session", "id", "replied_at")])


def first_in_window(entries: DataFrame, key: str = "key", at: str = "ts", ttl: str = "86400 seconds") -> DataFrame:
    """Cache entries that are new within their time to live."""
    return entries.withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])


def counts(events: DataFrame, at: str = "ts", window: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Events by type and tumbling window, late ones counted up to the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
