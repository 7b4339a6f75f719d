"""Streams of transactions: the review queue in event time, and the rules that look at a customer's earlier transactions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rippleset.config import FraudConfig
from rippleset.operators.transactions import minutes_since_previous, velocity_24h, with_previous
from rippleset.streaming.schema_events import run_stream
from rippleset.streaming.storage import read_batch, write_batch

STATE = "txn_id bigint, customer_id bigint, ts timestamp"


def review_windows(transactions: DataFrame, late: str = "5 minutes", length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """``start, end, n, total`` of flagged transactions (txn_id, ts, amount, flagged) in sliding windows of event time.

    On a stream a row may come ``late`` behind the newest one; what comes later than that is left out, and a window is given out once it is closed.
    """
    seen = transactions.withWatermark("ts", late) if transactions.isStreaming else transactions
    windows = seen.where("flagged").groupBy(F.window("ts", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    return windows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def review_stream(source: DataFrame, folder: str, checkpoint: str, **windows: str) -> StreamingQuery:
    """The closed windows of a stream, appended to ``folder`` exactly once (the sink keeps a log of its batches)."""
    return review_windows(source, **windows).writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def previous_alerts(transactions: DataFrame, config: FraudConfig | None = None) -> DataFrame:
    """``txn_id, customer_id, rule`` of transactions with too many before them in 24 hours (R3), or too soon after the last (R4)."""
    config = config or FraudConfig()
    given = transactions.select("txn_id", "customer_id", "ts", F.lit(None).cast("long").alias("location"))
    both = with_previous(given).join(velocity_24h(given).select("txn_id", "n_before"), "txn_id")
    gap = minutes_since_previous()
    soon = (gap < 24 * 60) & (F.floor(gap) < config.min_gap_minutes)
    rule = F.when(F.col("n_before") > config.max_per_day, "R3").when(soon, "R4")
    return both.select("txn_id", "customer_id", rule.alias("rule")).where("rule is not null")


def alert_stream(source: DataFrame, folder: str, state: str, checkpoint: str, config: FraudConfig | None = None, keep: timedelta = timedelta(hours=24)) -> StreamingQuery:
    """Alerts of a stream of transactions that come in the order of their time, batch by batch.

    The state is a customer's transactions of the last ``keep`` before the newest one seen: each batch is judged together with the state
    that the batch before it wrote, and writes what has not expired. Both are written under the batch's number.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("txn_id", "customer_id", "ts")
        before = read_batch(spark, state, number - 1, STATE)
        every = before.unionByName(fresh)
        newest = every.agg(F.max("ts")).first()[0]
        write_batch(every.where(F.col("ts") >= F.lit(newest - keep)) if newest else every, state, number)
        alerts = previous_alerts(every, config)
        write_batch(alerts.join(fresh.select("txn_id"), "txn_id", "left_semi"), folder, number)

    return run_stream(source, handle, checkpoint)
