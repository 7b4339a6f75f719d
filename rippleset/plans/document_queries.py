"""Queries of document-store changes. Their SQL says what the tables that the operations and documents were made of must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rippleset.operators import document_store as ds
from rippleset.plans import views as v

OPERATIONS = """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'CREATE COLLECTION c_' || user_id WHEN 1 THEN 'drop collection c_' || user_id WHEN 2 THEN 'db.c_' || user_id || '.createIndex({{"amount": 1, "ts": -1}})'
  WHEN 3 THEN 'db.c_' || user_id || '.dropIndex("amount_1")' WHEN 4 THEN 'MODIFY COLLECTION c_' || user_id WHEN 5 THEN 'accounts' ELSE '  ...' END AS statement FROM {events}
"""
SNAPSHOT_BEFORE = "SELECT 'c_' || p_size AS collection, CASE p_partkey % 9 WHEN 0 THEN '_id_' ELSE 'i_' || (p_partkey % 7) END AS index_name FROM {part} WHERE p_size % 5 <> 0 UNION ALL SELECT 'gone', '_id_' FROM {region}"
SNAPSHOT_AFTER = "SELECT 'c_' || p_size AS collection, CASE p_partkey % 8 WHEN 0 THEN CAST(NULL AS VARCHAR(9)) ELSE 'i_' || (p_partkey % 6) END AS index_name FROM {part} WHERE p_size % 6 <> 0"
DOCUMENTS = """
SELECT 'customers' AS collection, '{{"customer_id": ' || c_custkey || ', "nation_id": ' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN ', "note_id": null' ELSE '' END || '}}' AS value FROM {customer}
UNION ALL SELECT 'Orders', '{{"order_id": ' || o_orderkey || ', "customer_id": ' || o_custkey || ', "price": ' || o_totalprice || '}}' FROM {orders}
UNION ALL SELECT 'nations', CASE n_nationkey % 2 WHEN 0 THEN '{{broken' ELSE '{{"nation_id": ' || n_nationkey || ', "region_id": 1}}' END FROM {nation}
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "collection_operations": lambda s, d: ds.classify_operations(v.view(s, d, OPERATIONS)).drop("statement"),
    "snapshot_changes": lambda s, d: ds.snapshot_changes(v.view(s, d, SNAPSHOT_BEFORE), v.view(s, d, SNAPSHOT_AFTER)),
    "document_references": lambda s, d: ds.document_references(ds.inferred_fields(v.view(s, d, DOCUMENTS))),
}

_B, _A = v.sql(SNAPSHOT_BEFORE), v.sql(SNAPSHOT_AFTER)
ORACLES: dict[str, str] = {
    "collection_operations": """
      SELECT event_id, change_type, CASE event_id % 7 WHEN 5 THEN 'ACCOUNTS' WHEN 6 THEN NULL ELSE 'C_' || user_id END AS collection_name, field_name, index_name
      FROM events JOIN (VALUES (0, 'CREATE_COLLECTION', NULL, NULL), (1, 'DROP_COLLECTION', NULL, NULL), (2, 'CREATE_INDEX', 'AMOUNT', NULL), (3, 'DROP_INDEX', NULL, 'AMOUNT_1'), (4, 'MODIFY_COLLECTION', NULL, NULL), (5, 'MODIFY_COLLECTION', NULL, NULL), (6, NULL, NULL, NULL))
        AS f(form, change_type, field_name, index_name) ON event_id % 7 = form""",
    "snapshot_changes": f"""
      WITH b AS ({_B}), a AS ({_A})
      SELECT collection, NULL AS index_name, 'CREATE_COLLECTION' AS change_type, 'CREATE COLLECTION ' || collection AS statement FROM (SELECT collection FROM a EXCEPT SELECT collection FROM b)
      UNION ALL SELECT collection, NULL, 'DROP_COLLECTION', 'DROP COLLECTION ' || collection FROM (SELECT collection FROM b EXCEPT SELECT collection FROM a)
      UNION ALL SELECT collection, index_name, 'CREATE_INDEX', 'db.' || collection || '.createIndex(...)' FROM (SELECT collection, index_name FROM a EXCEPT SELECT * FROM b) WHERE index_name <> '_id_'
      UNION ALL SELECT collection, index_name, 'DROP_INDEX', 'db.' || collection || '.dropIndex(''' || index_name || ''')' FROM (SELECT collection, index_name FROM b EXCEPT SELECT * FROM a) WHERE index_name <> '_id_'""",
    "document_references": """
      SELECT * FROM (VALUES ('customers', 'FORWARD', 'NATION', 'nation_id'), ('customers', 'FORWARD', 'NOTE', 'note_id'), ('orders', 'FORWARD', 'CUSTOMER', 'customer_id'), ('nations', 'FORWARD', 'REGION', 'region_id'),
        ('customers', 'REVERSE', 'ORDERS', 'customer_id'), ('nations', 'REVERSE', 'CUSTOMERS', 'nation_id')) AS f(collection, direction, other, field) WHERE (SELECT count(*) FROM customer) > 0""",
}
