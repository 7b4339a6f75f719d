"""Streams from files: the same rows as in one batch, nothing new on a restart, and rows that come late."""

import json
from datetime import datetime, timedelta

from rippleset.config import FraudConfig
from rippleset.streaming import schema_events as se, transaction_events as te
from rippleset.streaming.storage import read_batches, shared_folder

LOG = [("ALTER TABLE t ADD COLUMN a INT", 3, 1.0), ("ALTER TABLE t ADD COLUMN b INT", 5, 1.0), ("ALTER TABLE t ADD COLUMN c INT", 5, 9.0), ("SELECT t", 99, 1.0)]


def notes():
    whole = {"tag": "ALTER TABLE", "object_identity": "public.t", "table_name": "t", "sql": "ALTER TABLE t DROP COLUMN x"}
    return [
        (json.dumps(whole), "ALTER TABLE t DROP COLUMN x"),
        (json.dumps(whole | {"operation": "DROP_COLUMN", "column_name": "y", "schema": "s"}), "ALTER TABLE s.t DROP COLUMN y"),
        (json.dumps(whole | {"sql": "ALTER TABLE t"}), "ALTER TABLE t ADD COLUMN c INT"),
        (json.dumps(whole | {"sql": None, "table_name": "unknown"}), "ALTER TABLE public.t"),
        (json.dumps({"tag": "DROP TABLE", "object_identity": "public.u", "sql": "NULL"}), "DROP TABLE public.u"),
        ("{broken", None), ("", None), ("[1]", None), ("17", None),
    ]


def test_completed(spark):
    raw = spark.createDataFrame([(n,) for n, _ in notes()], "value string")
    got = se.ddl_changes(raw, spark.createDataFrame(LOG, "query string, calls int, mean_ms double"))
    assert sorted(r["statement"] for r in got.collect()) == sorted(s for _, s in notes() if s)


def test_ddl_stream(spark, tmp_path):
    log = spark.createDataFrame(LOG, "query string, calls int, mean_ms double")
    folder, checkpoint, given = shared_folder(spark, "out"), shared_folder(spark, "check"), tmp_path / "in"
    given.mkdir()
    run = lambda: se.ddl_stream(se.payload_stream(spark, str(given), 1), log, folder, checkpoint).awaitTermination()
    rows = lambda: sorted(r["statement"] for r in read_batches(spark, folder, "statement string").collect())
    texts = [n for n, _ in notes()]
    (given / "a.txt").write_text("\n".join(texts[:3]))
    (given / "b.txt").write_text("\n".join(texts[3:5]))
    run()
    first = rows()
    run()  # a restart finds nothing new
    assert rows() == first and len(first) == 5
    (given / "c.txt").write_text("\n".join(texts))
    run()
    assert rows() == sorted(first + first)


def test_collections(spark, tmp_path):
    event = lambda seq, op, coll: json.dumps({"seq": seq, "operationType": op, "ns": {"coll": coll}})
    parts = [[event(1, "insert", "a"), event(2, "insert", "a"), event(3, "insert", "schema_notifications"), event(4, "update", "b"), "{", event(5, "insert", None)],
             [event(6, "insert", "a"), event(7, "invalidate", "a"), event(8, "insert", "a"), event(9, "insert", "b")], [event(10, "insert", "b"), event(11, "invalidate", "c"), event(12, "insert", "c")]]
    folder, state, checkpoint, given = shared_folder(spark, "out"), shared_folder(spark, "state"), shared_folder(spark, "check"), tmp_path / "in"
    given.mkdir()
    for n, part in enumerate(parts):
        (given / f"{n}.txt").write_text("\n".join(part))
        se.collection_stream(se.payload_stream(spark, str(given)), folder, state, checkpoint).awaitTermination()
    got = read_batches(spark, folder, "seq long, collection string, change_type string, statement string").collect()
    assert sorted((r["seq"], r["statement"]) for r in got) == [
        (1, "CREATE COLLECTION a"), (7, "DROP COLLECTION a"), (8, "CREATE COLLECTION a"), (9, "CREATE COLLECTION b"), (11, "DROP COLLECTION c"), (12, "CREATE COLLECTION c")]


def test_late_rows(spark, tmp_path):
    """A row within the bound counts, one behind it does not; windows come out once they are closed."""
    t = lambda minutes: datetime(2024, 1, 1, 12) + timedelta(minutes=minutes)
    schema, given = "txn_id int, ts timestamp, amount double, flagged boolean", str(tmp_path / "in")
    folder, checkpoint = shared_folder(spark, "out"), shared_folder(spark, "check")
    parts = [[(1, t(0), 1.0, True), (2, t(1), 2.0, False), (3, t(12), 4.0, True)], [(4, t(8), 8.0, True), (5, t(0), 16.0, True)], [(6, t(40), 32.0, True)]]
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(given)
        te.review_stream(spark.readStream.schema(schema).parquet(given), folder, checkpoint, slide="5 minutes").awaitTermination()
    got = sorted((r["start"], r["n"], r["total"]) for r in spark.read.parquet(folder).collect())
    assert got == [(t(0), 1, 1.0), (t(5), 1, 8.0), (t(10), 1, 4.0)]
    whole = te.review_windows(spark.createDataFrame([r for p in parts for r in p], schema), slide="5 minutes")
    assert sorted((r["start"], r["n"]) for r in whole.collect()) == [(t(0), 2), (t(5), 1), (t(10), 1), (t(40), 1)]


def test_alerts(spark, tmp_path):
    """State carried over batches gives the alerts of all rows at once, and rows expire."""
    t = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    rows = [(n, n % 2, t(40 * n)) for n in range(30)] + [(100, 0, t(1201)), (101, 7, t(1300)), (102, 7, t(1301)), (103, 7, t(3000)), (104, 0, t(3001))]
    rows.sort(key=lambda r: r[2])
    schema, given = "txn_id long, customer_id long, ts timestamp", str(tmp_path / "in")
    folder, state, checkpoint = (shared_folder(spark, n) for n in ("out", "state", "check"))
    config = FraudConfig(max_per_day=4, min_gap_minutes=5)
    for part in (rows[:7], rows[7:20], rows[20:33], rows[33:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(given)
        te.alert_stream(spark.readStream.schema(schema).parquet(given), folder, state, checkpoint, config).awaitTermination()
    got = sorted(tuple(r)[:3] for r in read_batches(spark, folder, "txn_id long, customer_id long, rule string").collect())
    want = sorted(tuple(r) for r in te.previous_alerts(spark.createDataFrame(rows, schema), config).collect())
    assert got == want and {r for _, _, r in got} == {"R3", "R4"}
    assert {r["txn_id"] for r in spark.read.parquet(f"{state}/batch=3").collect()} == {103, 104}
