"""Queries that run the streams over the given tables. A table goes in as parts, each followed by a run of the stream from the same checkpoint,
so all but the first run are restarts. Their SQL computes the result of the whole at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rippleset.config import FraudConfig
from rippleset.plans import views as v
from rippleset.streaming import schema_events as se, transaction_events as te
from rippleset.streaming.storage import read_batches, shared_folder

#: The driver's events are sparse, so the rules use lower bounds.
FRAUD = FraudConfig(max_per_day=4, min_gap_minutes=5)
PARTS = 3

#: A notification for each order: a whole statement, a dropped column, one to be looked up, one to be rebuilt, a dropped table, a broken payload.
NOTIFICATIONS = """
SELECT o_orderkey AS seq, CASE o_orderkey % 6
  WHEN 0 THEN '{{"tag": "ALTER TABLE", "object_identity": "public.accounts_' || o_custkey || '", "table_name": "accounts_' || o_custkey || '", "sql": "ALTER TABLE accounts_' || o_custkey || ' ADD COLUMN note VARCHAR(3)"}}'
  WHEN 1 THEN '{{"tag": "ALTER TABLE", "schema": "bank", "table_name": "accounts_' || o_custkey || '", "operation": "DROP_COLUMN", "column_name": "status", "sql": "ALTER TABLE x"}}'
  WHEN 2 THEN '{{"tag": "ALTER TABLE", "object_identity": "public.payments_' || o_custkey || '", "table_name": "payments_' || o_custkey || '", "sql": "ALTER TABLE payments_' || o_custkey || '"}}'
  WHEN 3 THEN '{{"tag": "ALTER TABLE", "object_identity": "public.visits_' || o_custkey || '", "table_name": "visits_' || o_custkey || '", "sql": null}}'
  WHEN 4 THEN '{{"tag": "DROP TABLE", "object_identity": "public.notes_' || o_custkey || '", "table_name": "notes_' || o_custkey || '", "sql": "NULL"}}'
  ELSE '{{"tag": "ALTER TABLE", "sql": ' || o_custkey END AS value
FROM {orders}
"""
STATEMENT_LOG = """
SELECT 'ALTER TABLE payments_' || c_custkey || CASE k WHEN 0 THEN ' RENAME COLUMN note TO remark' ELSE ' DROP COLUMN amount' END AS query, 5 + (c_custkey + k) % 2 AS calls, CAST(1 AS DOUBLE) AS mean_ms
FROM {customer} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) AS two WHERE c_custkey % 3 > 0
"""
COLLECTION_EVENTS = """
SELECT event_id AS seq, '{{"seq": ' || event_id || ', "operationType": "' || CASE event_id % 7 WHEN 0 THEN 'invalidate' WHEN 1 THEN 'update' ELSE 'insert' END || '", "ns": {{"coll": "' || CASE event_id % 13 WHEN 0 THEN 'schema_notifications' ELSE 'c_' || user_id END || '"}}}}' AS value
FROM {events}
"""


def _fed(given: DataFrame, place: str, folder: str, columns: list[str], start: Callable[[], StreamingQuery], text: bool = True) -> None:
    """Writes a table part by part, in the order of ``place`` (a number), and runs the stream after each."""
    cuts = given.select(F.expr(place).cast("double").alias("at")).approxQuantile("at", [k / PARTS for k in range(1, PARTS)], 0.01)
    bounds, at = [float("-inf"), *cuts, float("inf")], F.expr(place).cast("double")
    for low, high in zip(bounds, bounds[1:], strict=False):
        writer = given.where((at > low) & (at <= high)).select(*columns).write.mode("append")
        (writer.text if text else writer.parquet)(folder)
        start().awaitTermination()


def stream_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed changes of a stream of notifications, counted."""
    given, out, checkpoint = (shared_folder(spark, name) for name in ("notifications", "ddl-changes", "ddl-checkpoint"))
    log = v.view(spark, sf_dir, STATEMENT_LOG, "customer")
    _fed(v.view(spark, sf_dir, NOTIFICATIONS, "orders"), "seq", given, ["value"], lambda: se.ddl_stream(se.payload_stream(spark, given), log, out, checkpoint))
    found = read_batches(spark, out, "statement string, change_type string, table_name string, column_name string, new_value string")
    return found.groupBy("statement", "change_type", "table_name", "column_name", "new_value").agg(F.count(F.lit(1)).alias("n"))


def stream_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections created and dropped in a stream of events."""
    given, out, state, checkpoint = (shared_folder(spark, name) for name in ("collection-events", "collection-changes", "collection-state", "collection-checkpoint"))
    _fed(v.view(spark, sf_dir, COLLECTION_EVENTS), "seq", given, ["value"], lambda: se.collection_stream(se.payload_stream(spark, given), out, state, checkpoint))
    return read_batches(spark, out, "seq bigint, collection string, change_type string, statement string").drop("batch")


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the rules that look back, from a stream of transactions."""
    given, out, state, checkpoint = (shared_folder(spark, name) for name in ("transactions", "alerts", "alert-state", "alert-checkpoint"))
    rows = v.view(spark, sf_dir, v.TRANSACTIONS).select("txn_id", "customer_id", "ts")
    columns = ["txn_id", "customer_id", "ts"]
    source = lambda: spark.readStream.schema(rows.select(*columns).schema).parquet(given)
    _fed(rows, "unix_micros(ts)", given, columns, lambda: te.alert_stream(source(), out, state, checkpoint, FRAUD), text=False)
    return read_batches(spark, out, "txn_id bigint, customer_id bigint, rule string").drop("batch")


def stream_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed windows of the review queue, from a stream of transactions."""
    given, out, checkpoint = (shared_folder(spark, name) for name in ("review", "review-windows", "review-checkpoint"))
    rows = v.view(spark, sf_dir, v.TRANSACTIONS).select("txn_id", "ts", "amount", (F.col("amount") > 40).alias("flagged"))
    columns = ["txn_id", "ts", "amount", "flagged"]
    source = lambda: spark.readStream.schema(rows.select(*columns).schema).parquet(given)
    _fed(rows, "unix_micros(ts)", given, columns, lambda: te.review_stream(source(), out, checkpoint), text=False)
    return spark.read.parquet(out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"stream_ddl": stream_ddl, "stream_collections": stream_collections, "stream_alerts": stream_alerts, "stream_review": stream_review}

_T = v.sql(v.TRANSACTIONS)
ORACLES: dict[str, str] = {
    "stream_ddl": """
      WITH s AS (SELECT o_custkey AS k, CASE o_orderkey % 6 WHEN 2 THEN CASE o_custkey % 3 WHEN 0 THEN 20 ELSE 21 + o_custkey % 2 END ELSE o_orderkey % 6 END AS form FROM orders WHERE o_orderkey % 6 < 5)
      SELECT replace(statement, '#', k::VARCHAR) AS statement, change_type, replace(table_name, '#', k::VARCHAR) AS table_name, column_name, new_value, count(*) AS n
      FROM s JOIN (VALUES (0, 'ALTER TABLE accounts_# ADD COLUMN note VARCHAR(3)', 'ADD_COLUMN', 'ACCOUNTS_#', 'NOTE', 'VARCHAR(3)'), (1, 'ALTER TABLE bank.accounts_# DROP COLUMN status', 'DROP_COLUMN', 'ACCOUNTS_#', 'STATUS', NULL),
        (20, 'ALTER TABLE public.payments_#', 'ALTER_TABLE', 'PAYMENTS_#', NULL, NULL), (21, 'ALTER TABLE payments_# DROP COLUMN amount', 'DROP_COLUMN', 'PAYMENTS_#', 'AMOUNT', NULL), (22, 'ALTER TABLE payments_# RENAME COLUMN note TO remark', 'RENAME_COLUMN', 'PAYMENTS_#', 'NOTE', 'REMARK'),
        (3, 'ALTER TABLE public.visits_#', 'ALTER_TABLE', 'VISITS_#', NULL, NULL), (4, 'DROP TABLE public.notes_#', 'DROP_TABLE', 'NOTES_#', NULL, NULL)) AS f(form, statement, change_type, table_name, column_name, new_value) USING (form)
      GROUP BY ALL""",
    "stream_collections": """
      WITH e AS (SELECT event_id AS seq, 'c_' || user_id AS collection, event_id % 7 = 0 AS gone, lag(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_id % 7 <> 1 AND event_id % 13 <> 0)
      SELECT seq, collection, CASE WHEN gone THEN 'DROP' ELSE 'CREATE' END || '_COLLECTION' AS change_type, CASE WHEN gone THEN 'DROP' ELSE 'CREATE' END || ' COLLECTION ' || collection AS statement FROM e WHERE gone OR before IS NULL OR before = 0""",
    "stream_alerts": f"""
      WITH p AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY customer_id ORDER BY ts, txn_id))) AS gap, count(*) OVER (PARTITION BY customer_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1 AS n_before FROM ({_T}))
      SELECT txn_id, customer_id, CASE WHEN n_before > 4 THEN 'R3' ELSE 'R4' END AS rule FROM p WHERE n_before > 4 OR (gap < 86400000000 AND floor(gap / 60000000.0) < 5)""",
    "stream_review": f"""
      WITH f AS (SELECT ts, amount FROM ({_T}) WHERE amount > 40), w AS (SELECT date_trunc('minute', ts) - to_minutes(k::INT) AS start, amount FROM f, generate_series(0, 4) AS g(k))
      SELECT start, start + INTERVAL 5 MINUTE AS "end", count(*) AS n, sum(amount)::DECIMAL(28,2) AS total FROM w WHERE start + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 5 MINUTE FROM f) GROUP BY 1""",
}
