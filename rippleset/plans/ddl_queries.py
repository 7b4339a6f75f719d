"""Queries of DDL parsing. Their SQL says what the tables that the texts were made of must give; it never reads the texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleset.operators import ddl, schema_change as sc
from rippleset.plans import views as v

_REFERS = " || ".join(
    f"CASE WHEN c_nationkey % 5 >= {least} THEN ',' || chr(10) || '  foreign key (`r{k}`) references bank.' || {v._NAMED.format(f'c_custkey + {k}')} || '(id)' ELSE '' END" for k, least in ((1, 0), (4, 1), (8, 2), (12, 4)))

#: One schema file a customer: a table with nested brackets, commas and semicolons in quotes and comments, and its references.
DDL_FILES = f"""
SELECT 'schema/' || c_custkey || '.sql' AS path, '-- tables; of the bank, (one' || chr(10) || 'CREATE TABLE IF NOT EXISTS `bank`.`' || {v._NAMED.format('c_custkey')} || '` (' || chr(10)
  || '  id VARCHAR(36) PRIMARY KEY, -- a, b; c)' || chr(10) || '  amount DECIMAL(15, ' || (c_custkey % 7) || ') NOT NULL DEFAULT 0.00,' || chr(10) || '  note TEXT DEFAULT ''a, (b; --'' /* x, y */,' || chr(10)
  || '  owner_id INT REFERENCES owners(id),' || chr(10) || '  INDEX by_amount (amount, note),' || chr(10) || '  UNIQUE KEY (owner_id)' || {_REFERS} || chr(10) || ');' || chr(10)
  || '/* CREATE TABLE old (x INT); */ DROP TABLE old; create table T' || c_custkey || ' (x int)' AS content
FROM {{customer}}
"""


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ddl.table_definitions(v.view(spark, sf_dir, DDL_FILES, "customer"))


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).select("path", "table_name", F.array_join("indexes", ";").alias("indexes"), F.size("foreign_keys").alias("n_keys"), F.inline("columns"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ddl_columns": _columns,
    "ddl_relationships": lambda s, d: ddl.table_relationships(_tables(s, d)),
    "ddl_relation_counts": lambda s, d: sc.relation_counts(ddl.foreign_keys(_tables(s, d)).where("target_table <> 'owners'")),
}

_K = v.sql(v.FOREIGN_KEYS)
_OWN = v._NAMED.format("c_custkey")
_PAIRS = " UNION ALL ".join(f"SELECT {_OWN} AS s, {v._NAMED.format(f'c_custkey + {k}')} AS t, 'r{k}' AS c FROM customer WHERE c_nationkey % 5 >= {least}" for k, least in ((1, 0), (4, 1), (8, 2), (12, 4)))
ORACLES: dict[str, str] = {
    "ddl_columns": f"""
      SELECT 'schema/' || c_custkey || '.sql' AS path, {_OWN} AS table_name, 'by_amount(amount, note);unnamed(owner_id)' AS indexes,
        (1 + 1 + (c_nationkey % 5 >= 1)::INT + (c_nationkey % 5 >= 2)::INT + (c_nationkey % 5 >= 4)::INT)::INT AS n_keys, name, replace(type, '#', (c_custkey % 7)::VARCHAR) AS type, nullable, default_value, primary_key
      FROM customer, (VALUES ('id', 'VARCHAR(36)', true, NULL, true), ('amount', 'DECIMAL(15, #)', false, '0.00', false), ('note', 'TEXT', true, '''a, (b; --''', false), ('owner_id', 'INT', true, NULL, false)) AS f(name, type, nullable, default_value, primary_key)
      UNION ALL SELECT 'schema/' || c_custkey || '.sql', 'T' || c_custkey, '', 0, 'x', 'int', true, NULL, false FROM customer""",
    "ddl_relationships": f"""
      WITH d AS (SELECT {_OWN} AS t FROM customer), k AS ({_PAIRS} UNION ALL SELECT {_OWN}, 'owners', 'owner_id' FROM customer)
      SELECT s AS table_name, 'FOREIGN_KEY' AS type, t AS other_table, c AS "column", 'id' AS references_column FROM k
      UNION ALL SELECT t, 'REFERENCED_BY', s, c, 'id' FROM k WHERE t IN (SELECT t FROM d)""",
    "ddl_relation_counts": f"""
      SELECT coalesce(a.t, b.t) AS table_name, coalesce(n_forward, 0) AS n_forward, coalesce(n_reverse, 0) AS n_reverse
      FROM (SELECT source_table AS t, count(*) AS n_forward FROM ({_K}) GROUP BY 1) a FULL JOIN (SELECT target_table AS t, count(*) AS n_reverse FROM ({_K}) GROUP BY 1) b ON a.t = b.t""",
}
