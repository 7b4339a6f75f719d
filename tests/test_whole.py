"""Rules and forms that the driver's tables do not hold, on literal rows."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from rippleset.operators import schema_change as sc, transactions as tx
from rippleset.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["module_reachable_forward", "module_reachable_reverse"])
def test_three_steps(spark, name):
    found = QUERIES[name](spark, SF).select("risk", "farthest").distinct().collect()
    assert {r["farthest"] for r in found if r["risk"] == "low"} == {3}
    assert any(r["risk"] == "medium" and r["farthest"] == 2 for r in found)
    assert any(r["risk"] == "high" and r["farthest"] == 1 for r in found) or name.endswith("forward")  # forward, the steps 1 and 2 are both medium


def test_nine_rules(spark):
    start = datetime(2024, 3, 5, 8)
    rows, want = [], {}

    def customer(rule, amount=100, hours=30, country="AA", device="d", place="p", km=None, score=0.1, age=100):
        """Quiet transactions, then the one in question."""
        k = len(want)
        rows.extend((100 * k + i, k, start + timedelta(days=2 * i), Decimal(6000), "d", "p", None, "AA", 0.1, 100) for i in range(3))
        rows.append((100 * k + 9, k, start + timedelta(days=4, hours=hours), Decimal(amount), device, place, km, country, score, age))
        want[100 * k + 9] = rule

    customer(None)
    customer("R1", 50001)
    customer("R4", hours=0.02)
    customer("R5", hours=1.99, place="q", km=501.0)
    for free in ({"hours": 2.0, "place": "q", "km": 501.0}, {"hours": 1.0, "place": "q", "km": 500.0}, {"hours": 1.0, "place": "q"}, {"country": None, "score": None, "age": None}, {"amount": 5000, "age": 6}, {"amount": 5001, "age": 7}, {"score": 0.85}):
        customer(None, **free)
    customer("R6", country="YY", device="new", amount=10001)
    customer("R7", device="new", amount=10001, score=0.9)
    customer("R7", device=None, amount=10001)
    customer(None, device="new", amount=10000)
    customer("R8", score=0.86, age=1, amount=5001)
    customer("R9", amount=5001, age=6)
    txns = spark.createDataFrame(rows, "txn_id long, customer_id long, ts timestamp, amount decimal(18,2), device string, location string, distance_km double, country string, model_score double, account_age_days int")
    devices = txns.where("device = 'd'").select("customer_id", "device")
    got = {r["txn_id"]: r["rule"] for r in tx.fraud_alerts(txns, devices=devices).collect()}
    assert got == {i: rule for i, rule in want.items() if rule}
    plain = tx.fraud_alerts(txns.drop("distance_km", "country", "model_score", "account_age_days"))
    assert {r["rule"] for r in plain.collect()} == {"R1", "R4"}


def test_fraud_rejects(spark):
    schema = "payment_id long, amount decimal(18,2), type string, hour int, premium boolean, balance decimal(18,2), blocked boolean, overdraft boolean, risk decimal(4,2)"
    payments = spark.createDataFrame([(i, Decimal(10), "ACH", 1, False, Decimal(99), i == 4, False, Decimal(risk)) for i, risk in ((1, "0.1"), (2, "0.1"), (3, "0.9"), (4, "0.1"))], schema)
    alerts = spark.createDataFrame([(2,), (2,), (3,), (4,)], "txn_id long")
    got = {r["payment_id"]: (r["decision"], r["total"]) for r in tx.payment_decisions(payments, alerts=alerts).collect()}
    assert got == {1: ("COMPLETED", Decimal(12)), 2: ("REJECTED", None), 3: ("REJECTED", None), 4: ("BLOCKED", None)}


def test_report_bound(spark):
    txns = spark.createDataFrame([(k, datetime(2024, 1, 1)) for k in range(3)], "customer_id int, ts timestamp")
    risks = spark.createDataFrame([(0, Decimal("0.50")), (1, Decimal("0.85")), (2, Decimal("0.86"))], "customer_id int, score decimal(4,2)")
    assert tx.daily_fraud_report(txns, risks).first()["high_risk"] == 1


def test_call_forms(spark):
    lines = ['fetch("/a")', "await fetch ( '/x')", "fetch  ('/b', { method: 'PUT' })", "axios.Post('/c')", 'http.get ("/d")', 'requests.delete("/e", x)', 'restTemplate.getForObject("/f", A.class)', "RestTemplate.postForEntity('/g')", '@PostMapping("/h")', "@getmapping('/i')",
             'axios.get("/j"); fetch("/k")', 'log("/no")', 'axios.get("no")', "axios.get('/no\")"]
    files = spark.createDataFrame([("r", "f", "\n".join(lines))], "repo string, path string, content string")
    got = sorted((r["line"], r["path"]) for r in sc.call_sites(files).collect())
    assert got == [(1, "/a"), *((n, f"/{c}") for n, c in zip(range(3, 12), "bcdefghij", strict=True)), (11, "/k")]


def test_usage_forms(spark):
    content = """x = 1
a = "SELECT b FROM one"; b = 'delete from two'
c = \'\'\'
  SELECT *
  FROM three JOIN four
\'\'\'
say "select all
d = "UPDATE five SET x = 'DELETE it'"
e = \"\"\"INSERT INTO six
VALUES ("q")\"\"\"
f = 'SELECT a
  FROM seven'
g = \"\"\"SELECT a FROM eight\"\"\"
"""
    files = spark.createDataFrame([("r", "f", content), ("r", "g", None), ("r", "h", ""), ("r", "i", "'SELECT " + "x, " * 200_000 + "y FROM long'")], "repo string, path string, content string")
    got = sorted((r["path"], r["line"], r["query_type"], r["table_name"]) for r in sc.usages(files).collect())
    assert ("i", 1, "SELECT", "long") in got
    assert [x[1:] for x in got if x[0] == "f"] == [(2, "DELETE", "two"), (2, "SELECT", "one"), (3, "SELECT", "four"), (3, "SELECT", "three"), (8, "UPDATE", "five"), (9, "INSERT", "six"), (11, "SELECT", "seven"), (13, "SELECT", "eight")]


@pytest.mark.parametrize(
    ("statement", "kind", "table", "column", "new", "old", "constraint"),
    [
        ("DROP VIEW v", None, None, None, None, None, None), ("DROP FUNCTION f", None, None, None, None, None, None), (None, None, None, None, None, None, None), ("", None, None, None, None, None, None),
        ("INSERT INTO log VALUES ('RENAME TO x')", None, None, None, None, None, None), ("UPDATE t SET a = 'ALTER TABLE t ADD COLUMN c'", None, None, None, None, None, None),
        ("ALTER TABLE t ADD PRIMARY KEY (id)", "ADD_CONSTRAINT", "T", None, None, None, "PRIMARY_KEY"), ("ALTER TABLE t ADD FOREIGN KEY (a) REFERENCES b(c)", "ADD_CONSTRAINT", "T", None, None, None, "FOREIGN_KEY"),
        ("ALTER TABLE t ADD CONSTRAINT k CHECK (a > 1)", "ADD_CONSTRAINT", "T", "K", None, None, "CHECK"), ("ALTER TABLE t ADD CONSTRAINT k", "ADD_CONSTRAINT", "T", "K", None, None, "CONSTRAINT"),
        ("ALTER TABLE t DROP PRIMARY KEY", "DROP_CONSTRAINT", "T", None, None, None, None), ("ALTER TABLE t ADD UNIQUE INDEX ix (a)", "ADD_INDEX", "T", "IX", None, None, None),
        ("ALTER TABLE t DROP INDEX ix", "DROP_INDEX", "T", "IX", None, None, None), ("drop index ix on s.t", "DROP_INDEX", "T", "IX", None, None, None),
        ("ALTER TABLE `s`.`t` RENAME COLUMN `a` TO b", "RENAME_COLUMN", "T", "A", "B", "A", None), ("ALTER TABLE t RENAME TO u", "RENAME_TABLE", "T", None, "U", "T", None),
        ("ALTER TABLE t ADD COLUMN c TEXT DEFAULT 'x RENAME TO y' ...", "ADD_COLUMN", "T", "C", "TEXT", None, None), ("ALTER TABLE public.t ...", "ALTER_TABLE", "T", None, None, None, None),
    ],
)
def test_classes(spark, statement, kind, table, column, new, old, constraint):
    row = sc.classify(spark.createDataFrame([(statement, "kept")], "statement string, _text string")).first()
    if kind is None:
        assert row["change_type"] is None
    else:
        assert (row["change_type"], row["table_name"], row["column_name"], row["new_value"], row["old_value"], row["constraint_kind"], row["_text"]) == (kind, table, column, new, old, constraint, "kept")


def test_statements_in_code(spark):
    text = '''String a = "SELECT x FROM public.accounts JOIN `visits` v ON 1 = 1";
b = 'UPDATE "rows" SET a = 1'
c = """
   DELETE FROM notes
   WHERE day = EXTRACT(DAY FROM ts)
"""
String d = "SELECT 'DELETE me' FROM inner_quotes";
String e = "INSERT INTO two
   VALUES (1)";
not = "from here"; open = "SELECT y FROM unclosed
'''
    found = sc.usages(spark.createDataFrame([("r", "a", text), ("r", "b", None), ("r", "c", "")], "repo string, path string, content string")).collect()
    assert sorted((r["line"], r["query_type"], r["table_name"]) for r in found) == [(1, "SELECT", "accounts"), (1, "SELECT", "visits"), (2, "UPDATE", "rows"), (3, "DELETE", "notes"), (7, "SELECT", "inner_quotes"), (8, "INSERT", "two")]


def test_statements_in_linear_time(spark):
    """Files of 1 MB, without a statement and full of quotes that open none, are read in seconds."""
    import time

    big = [("r", "a", "int x = 1;\n" * 90_000), ("r", "b", 'f("a", \'b\', """);\n' * 50_000 + '"SELECT 1 FROM t"'), ("r", "c", '"SELECT \n' * 100_000)]
    df = spark.createDataFrame(big, "repo string, path string, content string")
    began = time.time()
    assert {r["path"] for r in sc.usages(df).select("path", "table_name").collect()} <= {"a", "b", "c"}
    assert time.time() - began < 60


def test_unchanged_contract(spark):
    """No return type on either side is no change, and the last of repeated endpoints counts."""
    schema = "change_set string, method string, path string, return_type string, required_params int, line int"
    before = spark.createDataFrame([("s", "GET", "/a", None, 0, 1), ("s", "GET", "/b", "X", 1, 1), ("s", "GET", "/b", "X", 2, 2), ("s", "GET", "/c", "X", 0, 1)], schema)
    after = spark.createDataFrame([("s", "GET", "/a", None, 0, 1), ("s", "GET", "/b", "X", 2, 7), ("s", "GET", "/b", "X", 0, 3), ("s", "GET", "/d", None, 0, 1)], schema)
    assert sorted(tuple(r) for r in sc.contract_diff(before, after).collect()) == [("GET", "/c", "s", "BREAKING"), ("GET", "/d", "s", "ADDED")]


def test_office_hours(spark):
    rows = [(1, 8 * 3600), (2, 8 * 3600 + 60), (3, 17 * 3600 - 1), (4, 17 * 3600)]
    payments = spark.createDataFrame([(i, "WIRE", Decimal(60000), False, s // 3600, s) for i, s in rows], "payment_id int, type string, amount decimal(18,2), premium boolean, hour int, second_of_day int")
    assert {r["payment_id"]: float(r["fee"]) for r in tx.fees(payments).collect()} == {1: 30.0, 2: 33.0, 3: 33.0, 4: 30.0}


def test_database_types(spark):
    rows = [("mongodb_bank", None, None), ("my_Mongo", None, "x"), ("bank", None, "db.t.createIndex({a: 1})"), ("bank", "PostgreSQL", "db.t.find()"), ("bank", "", "Drop Collection c"), ("bank", None, "ALTER TABLE t"), (None, None, None)]
    df = spark.createDataFrame(rows, "name string, told string, statement string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(sc.database_type(F.col("name"), F.col("told"), F.col("statement"))).collect()]
    assert got == ["mongodb", "mongodb", "mongodb", "postgresql", "mongodb", "postgresql", "postgresql"]


def test_concerns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, None), (0, "N/A"), (0, "privacy"), (4, "privacy"), (5, "none"), (2, "")], "n int, c string")
    assert [float(r[0]) for r in df.select(sc.ai_points(F.col("n"), F.col("c"))).collect()] == [0.0, 0.0, 0.5, 2.0, 1.5, 1.0]
