"""Views that give the driver's tables the shapes of the library's inputs. One SQL text each, for Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSACTIONS = """
SELECT event_id AS txn_id, user_id AS customer_id, CAST(ts AS TIMESTAMP) AS ts, CAST(value AS DECIMAL(18,2)) AS amount, event_type,
  event_id % 23 AS device, event_id % 9 AS location FROM {events}
"""

PAYMENTS = """
SELECT o_orderkey AS payment_id, o_custkey AS customer_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderdate AS ts,
  CASE o_orderkey % 5 WHEN 0 THEN 'DOMESTIC' WHEN 1 THEN 'INTERNATIONAL' WHEN 2 THEN 'ACH' WHEN 3 THEN 'WIRE' ELSE 'OTHER' END AS type,
  o_orderkey % 24 AS hour, c_mktsegment = 'BUILDING' AS premium, CAST(c_acctbal * 40 AS DECIMAL(18,2)) AS balance,
  c_custkey % 17 = 0 AS blocked, c_custkey % 3 = 0 AS overdraft, CAST(c_custkey % 100 AS DECIMAL(18,2)) / 100 AS risk
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

#: Names grow with the data, so that files, changes and relations per table stay as few at every size.
SCHEMA_EVENTS = """
SELECT o_orderkey AS event_id, o_orderdate AS ts, CASE o_orderkey % 15
  WHEN 0 THEN 'DROP TABLE IF EXISTS public.' || t WHEN 1 THEN 'CREATE UNIQUE INDEX ix_' || c || ' ON ' || t || ' (' || c || ')'
  WHEN 2 THEN 'DROP INDEX ix_' || c || ' ON ' || t WHEN 3 THEN 'ALTER TABLE ' || t || ' ALTER COLUMN ' || c || ' SET DEFAULT 0'
  WHEN 4 THEN 'ALTER TABLE ' || t || ' ALTER COLUMN ' || c || ' DROP DEFAULT' WHEN 5 THEN 'ALTER TABLE ' || t || ' ALTER COLUMN ' || c || ' SET NOT NULL'
  WHEN 6 THEN 'alter table ' || t || ' alter column ' || c || ' drop not null' WHEN 7 THEN 'ALTER TABLE ' || t || ' MODIFY COLUMN ' || c || ' DECIMAL(15, 2)'
  WHEN 8 THEN 'ALTER TABLE ' || t || ' RENAME COLUMN ' || c || ' TO ' || c || '_new' WHEN 9 THEN 'ALTER TABLE ' || t || ' ADD CONSTRAINT k_' || c || ' UNIQUE (' || c || ')'
  WHEN 10 THEN 'ALTER TABLE ' || t || ' DROP CONSTRAINT k_' || c WHEN 11 THEN 'ALTER TABLE ' || t || ' ADD COLUMN ' || c || ' VARCHAR(3)'
  WHEN 12 THEN 'ALTER TABLE ' || t || ' DROP COLUMN ' || c WHEN 13 THEN 'ALTER TABLE ' || t || ' RENAME TO ' || t || '_old' ELSE 'ALTER TABLE ' || t END AS statement,
  CASE WHEN o_orderkey % 8 = 0 THEN 'mongodb_bank' ELSE 'bank' END AS database_name, o_orderkey % 6 AS ai_risks
FROM (SELECT *, CASE o_custkey % 4 WHEN 0 THEN 'payments_' WHEN 1 THEN 'accounts_' WHEN 2 THEN 'notes_' ELSE 'visits_' END || o_custkey AS t,
  CASE o_orderkey % 3 WHEN 0 THEN 'amount' WHEN 1 THEN 'status' ELSE 'note' END AS c FROM {orders})
"""

#: One file a line item; a file queries the table of its order's customer number range.
CODE_FILES = """
SELECT 'repo' || (l_orderkey % 5) AS repo, 'src/' || CASE l_partkey % 4 WHEN 0 THEN 'payment' WHEN 1 THEN 'account' WHEN 2 THEN 'report' ELSE 'util' END || '/Dao_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '.java' AS path,
  'class Dao {{' || chr(10) || '  String q = "SELECT status, amount FROM ' || t || ' WHERE note = 1";' || chr(10) || CASE WHEN l_linenumber % 2 = 0 THEN '  String u = "UPDATE ' || t || ' SET amount = 2";' || chr(10) ELSE '' END
  || CASE WHEN l_linenumber % 3 = 0 THEN '  axios.get("/api/part/' || l_partkey || '");' || chr(10) ELSE '' END || '}}' AS content
FROM (SELECT *, CASE l_suppkey % 4 WHEN 0 THEN 'payments_' WHEN 1 THEN 'accounts_' WHEN 2 THEN 'notes_' ELSE 'visits_' END || (l_orderkey - l_orderkey % 4 + l_suppkey % 4) % (SELECT count(*) FROM {customer}) AS t FROM {lineitem})
"""

#: Tables refer to the tables of the parts' sizes beside them: at most four either way.
_NAMED = "CASE ({0}) % 4 WHEN 0 THEN 'payments_' WHEN 1 THEN 'accounts_' WHEN 2 THEN 'notes_' ELSE 'visits_' END || ({0})"
FOREIGN_KEYS = " UNION ALL ".join(
    f"SELECT {_NAMED.format('c_custkey')} AS source_table, {_NAMED.format(f'c_custkey + {k}')} AS target_table FROM {{customer}} WHERE c_nationkey % 5 >= {least}"
    for k, least in ((1, 0), (4, 1), (8, 2), (12, 4)))

#: A part depends on the part of the next line of its order.
EDGES = """
SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst, CASE a.l_orderkey % 7 WHEN 0 THEN 'CALL' WHEN 1 THEN 'USE' WHEN 2 THEN 'IMPORT' WHEN 3 THEN 'CREATE' WHEN 4 THEN 'CONTAIN' WHEN 5 THEN 'RETURN' ELSE 'EXTEND' END AS rel_type
FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey
"""

CONTRACTS_BEFORE = """
SELECT CASE p_size % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END AS method, '/api/part/' || p_partkey AS path,
  CASE p_partkey % 3 WHEN 0 THEN 'Order' WHEN 1 THEN 'Part' ELSE 'void' END AS return_type, CAST(p_partkey % 3 AS INT) AS required_params, p_brand AS change_set
FROM {part} WHERE p_partkey % 10 <> 9
"""
CONTRACTS_AFTER = """
SELECT CASE p_size % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END AS method, '/api/part/' || p_partkey AS path,
  CASE WHEN p_partkey % 10 = 3 THEN 'Changed' WHEN p_partkey % 3 = 0 THEN 'Order' WHEN p_partkey % 3 = 1 THEN 'Part' ELSE 'void' END AS return_type,
  CAST(p_partkey % 3 + CASE WHEN p_partkey % 10 = 5 THEN 1 WHEN p_partkey % 10 = 6 AND p_partkey % 3 > 0 THEN -1 ELSE 0 END AS INT) AS required_params, p_brand AS change_set
FROM {part} WHERE p_partkey % 10 <> 1
"""

CODE_CHANGES = """
SELECT o_orderkey AS change_id, 'src/' || CASE o_custkey % 3 WHEN 0 THEN 'payment' WHEN 1 THEN 'report' ELSE 'util' END || '/File_' || o_orderkey || '.java' AS path,
  o_custkey % 20 AS complexity, o_orderkey % 130 AS lines_changed, o_orderkey % 8 AS n_tables, o_orderkey % 6 AS ai_risks FROM {orders}
"""

#: Lines of four orders in a row are the dependencies of one change; the others have none.
DEPENDENCIES = """
SELECT l_orderkey - l_orderkey % 4 AS change_id, CASE l_partkey % 6 WHEN 0 THEN 'PaymentDAO' WHEN 1 THEN 'AuditLog' WHEN 2 THEN 'LookupTable' ELSE 'Dates' END || l_partkey AS target FROM {lineitem}
"""

#: Every line item asks for a reversal; those not returned name a payment that does not exist.
REVERSAL_REQUESTS = """
SELECT CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS request_id, l_orderkey + CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_linenumber AS BIGINT) * 1000000000 END AS payment_id FROM {lineitem}
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


#: Keys by which a table's rows are dealt over tasks, and the rows that one task reads.
KEYS = {"customer": ("c_custkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber")}
ROWS_PER_TASK = 50_000


#: Rows of a table that a view in parts joins at a time, and its parts at most: each of them reads the table's columns again.
ROWS_PER_PART, PARTS = 30_000_000, 8


def _tables(spark: SparkSession, sf_dir: str, text: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES if "{" + name + "}" in text}


def view(spark: SparkSession, sf_dir: str, text: str, spread: str | None = None) -> DataFrame:
    """A view over an input folder's tables.

    ``spread`` names the table whose rows become texts that are parsed. Its narrow rows are dealt over tasks first, as many as the rows ask for:
    a small file of few row groups is one task's scan, and would leave all parsing to that task.
    """
    used = _tables(spark, sf_dir, text)
    if spread is not None:
        tasks = max(spark.sparkContext.defaultParallelism, -(-used[spread].count() // ROWS_PER_TASK))
        used[spread] = used[spread].repartition(tasks, *KEYS[spread])
    return spark.sql(text, **used)


def parts(spark: SparkSession, sf_dir: str, text: str, table: str) -> list[DataFrame]:
    """A view that joins rows of ``table`` by its first key alone, in parts by that key, so that one part's shuffles can go before the next.

    Together they hold the view's rows; what is distinct in the view is distinct in each part.
    """
    used = _tables(spark, sf_dir, text)
    n = max(1, min(PARTS, -(-used[table].count() // ROWS_PER_PART)))
    part = F.pmod(F.xxhash64(KEYS[table][0]), F.lit(n))
    return [spark.sql(text, **used | {table: used[table].where(part == k)}) for k in range(n)] if n > 1 else [spark.sql(text, **used)]


def sql(text: str) -> str:
    """The same text over tables of these names."""
    return text.format(**{name: name for name in TABLES})
