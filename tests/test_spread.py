"""Tables of few row groups whose rows become texts."""

import pytest

from rippleset.plans import api_queries, ddl_queries, graph_queries, stream_queries, usage_queries, views as v
from tests.test_parity import SF


@pytest.mark.parametrize(("text", "table"), [
    (v.CODE_FILES, "lineitem"), (v.SCHEMA_EVENTS, "orders"), (usage_queries.USAGE_FILES, "part"), (ddl_queries.DDL_FILES, "customer"), (api_queries.API_DIFFS, "part"), (api_queries.API_FILES, "part"),
    (graph_queries.MATRICES, "part"), (stream_queries.NOTIFICATIONS, "orders")])
def test_rows_are_dealt(spark, monkeypatch, text, table):
    """One file gives as many tasks as its rows ask for, none of them with more than its share by far, and the rows stay the same."""
    monkeypatch.setattr(v, "ROWS_PER_TASK", 10)
    dealt, plain = v.view(spark, SF, text, table), v.view(spark, SF, text)
    sizes = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    n = plain.count()
    assert len(sizes) == max(8, -(-n // 10)) and max(sizes) < 60 + n / 4
    assert dealt.exceptAll(plain).isEmpty() and sum(sizes) == n


def test_statements_are_read_once(spark):
    """Each pattern over a whole statement or file stands once in the plan, and is not copied to every place that uses what it found."""
    from pyspark.sql import functions as F

    from rippleset.operators import schema_change as sc, usages as us

    files = spark.createDataFrame([("r", "p", "x = \"SELECT a, t.b FROM t JOIN u\"\n")], "repo string, path string, content string")
    found = sc.usages(files)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert plan(found).count(sc.OPENING) == 1
    columns = us.column_usages(found)
    assert plan(columns).count(us.COMPARED) == 1 and plan(files.select(us.query_columns(F.col("content")).alias("c"))).count(us.COMPARED) == 1
    assert sorted((r["table_name"], *sorted(r["columns"])) for r in columns.collect()) == [("t", "a", "b"), ("u", "a")]


def test_whole_statements_are_dealt(spark):
    """Notifications that look nothing up in the log don't meet in one task, and come out as they were."""
    from rippleset.streaming import schema_events as se

    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        none = "cast(null as string)"
        events = spark.range(800).selectExpr("'ALTER TABLE' as tag", f"{none} as object_identity", f"{none} as schema", "concat('ALTER TABLE t', id, ' ADD COLUMN c INT') as sql", "concat('t', id) as table_name", f"{none} as operation", f"{none} as column_name", f"{none} as object_type")
        log = spark.createDataFrame([("ALTER TABLE t1 DROP COLUMN x", 1, 1.0)], "query string, calls int, mean_ms double")
        done = se.completed(events, log)
        sizes = done.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(sizes) == 800 and max(sizes) < 300
        assert done.columns == [*events.columns, "statement"] and done.where("statement <> sql").isEmpty()
    finally:
        for k, x in kept.items():
            spark.conf.set(k, x)
