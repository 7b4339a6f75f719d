"""Document-store operations, snapshots and references on literal rows."""

from rippleset.operators import document_store as ds


def test_operations(spark):
    want = {
        "CREATE COLLECTION payments": ("CREATE_COLLECTION", "PAYMENTS", None, None), " drop collection payments": ("DROP_COLLECTION", "PAYMENTS", None, None),
        "db.transactions.createIndex({amount: 1, processed_at: -1})": ("CREATE_INDEX", "TRANSACTIONS", "AMOUNT", None), "db.t.createIndex()": ("CREATE_INDEX", "T", None, None),
        "db.transactions.dropIndex('amount_1')": ("DROP_INDEX", "TRANSACTIONS", None, "AMOUNT_1"), "db.t.dropIndex(x)": ("DROP_INDEX", "T", None, None),
        "MODIFY COLLECTION t": ("MODIFY_COLLECTION", "T", None, None), "accounts": ("MODIFY_COLLECTION", "ACCOUNTS", None, None), "abc": ("MODIFY_COLLECTION", "ABC", None, None), "": (None, None, None, None), " ? ": (None, None, None, None)}
    df = spark.createDataFrame([(s, "x") for s in want] + [(None, "x")], "statement string, kind string")
    got = {r["statement"]: (r["change_type"], r["collection_name"], r["field_name"], r["index_name"]) for r in ds.classify_operations(df).collect()}
    assert got == {**want, None: (None, None, None, None)}
    strict = {r["statement"]: r["change_type"] for r in ds.classify_operations(df, strict=True).collect()}
    assert strict["abc"] is None and strict["accounts"] == "MODIFY_COLLECTION"


def test_snapshots(spark):
    schema = "collection string, index_name string"
    before = spark.createDataFrame([("a", "_id_"), ("a", "x"), ("a", "x"), ("b", None), ("c", "y"), (None, "z")], schema)
    after = spark.createDataFrame([("a", "x"), ("a", "w"), ("c", None), ("d", "_id_")], schema)
    got = sorted((r["change_type"], r["collection"], r["index_name"], r["statement"]) for r in ds.snapshot_changes(before, after).collect())
    assert got == [("CREATE_COLLECTION", "d", None, "CREATE COLLECTION d"), ("CREATE_INDEX", "a", "w", "db.a.createIndex(...)"), ("DROP_COLLECTION", "b", None, "DROP COLLECTION b"), ("DROP_INDEX", "c", "y", "db.c.dropIndex('y')")]
    assert ds.snapshot_changes(before.limit(0), after.limit(0)).collect() == []


def test_references(spark):
    rows = [("accounts", '{"account_id": 1, "customer_id": 2}'), ("accounts", "[1]"), ("accounts", None), ("accounts", "{bad"), ("Customers", '{"customer_id": 1}'), ("history", '{"transaction_id": 1, "Customer_ID": 1, "x": {"y_id": 1}}')]
    fields = ds.inferred_fields(spark.createDataFrame(rows, "collection string, value string"))
    assert {(r["collection"], r["field"]): r["n"] for r in fields.collect()}["accounts", "customer_id"] == 1
    assert sorted(tuple(r) for r in ds.document_references(fields).collect()) == [
        ("accounts", "FORWARD", "CUSTOMER", "customer_id"), ("customers", "REVERSE", "ACCOUNTS", "customer_id"), ("customers", "REVERSE", "HISTORY", "customer_id"), ("history", "FORWARD", "CUSTOMER", "customer_id"), ("history", "FORWARD", "TRANSACTION", "transaction_id")]
