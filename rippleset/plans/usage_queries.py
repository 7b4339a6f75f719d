"""Queries of the other usage extractors. Their SQL says what the tables that the files were made of must give; it never reads the files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleset.operators import schema_change as sc, usages as us
from rippleset.plans import views as v

#: One file a part with an entity, a mapped table, names that hint at tables, calls on collections and two statements.
USAGE_FILES = """
SELECT 'repo' || (p_partkey % 5) AS repo, 'src/Store' || p_partkey || '.java' AS path, '@Entity(name = "lots_' || p_partkey || '")' || chr(10) || '@Table(schema = "bank", name = "payments_' || p_partkey || '")' || chr(10)
  || 'class TransactionStore {{' || chr(10) || '  private AccountBalance balanceOf;' || chr(10) || '  __tablename__ = ' || chr(39) || 'notes_' || p_partkey || chr(39) || chr(10)
  || '  db.visits_' || p_partkey || '.find({{}}); x.getCollection("rows_' || p_partkey || '"); mongo("db".find())' || chr(10)
  || '  String q = "SELECT p.status, SUM(v.amount) AS total, level FROM bank.payments_' || p_partkey || ' p JOIN `visits_' || p_partkey || '` AS v ON p.id = v.ref WHERE p.kind = ' || p_size || ' AND note IS NULL ORDER BY p.day";' || chr(10)
  || '  sql = ' || chr(39) || chr(39) || chr(39) || chr(10) || '    UPDATE payments_' || p_partkey || chr(10) || '    SET status = "x", day = EXTRACT(DAY FROM ts)' || chr(10) || '    WHERE id IN (1)' || chr(39) || chr(39) || chr(39) || chr(10) || '}}' AS content
FROM {part}
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.view(spark, sf_dir, USAGE_FILES, "part")


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.column_usages(sc.usages(_files(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "all_usages": lambda s, d: us.all_usages(_files(s, d)),
    "column_usages": lambda s, d: _columns(s, d).withColumn("columns", F.array_join(F.array_sort("columns"), ",")),
    "usages_of_column": lambda s, d: us.usages_of_column(_columns(s, d), F.lit("Status")).select("path", "table_name", "line"),
}

_ROWS = """
SELECT 'repo' || (p_partkey % 5) AS repo, 'src/Store' || p_partkey || '.java' AS path, line, query_type, replace(table_name, '#', p_partkey::VARCHAR) AS table_name FROM part, (VALUES
  (1, 'ORM_ENTITY', 'lots_#'), (2, 'ORM_ENTITY', 'payments_#'), (2, 'ORM_ENTITY', 'payments_#'), (5, 'ORM_ENTITY', 'notes_#'), (3, 'HEURISTIC', 'transactions'), (3, 'HEURISTIC', 'transactions'), (4, 'HEURISTIC', 'accounts'), (4, 'HEURISTIC', 'account_balances'),
  (6, 'MONGO_OPERATION', 'visits_#'), (6, 'MONGO_OPERATION', 'rows_#'), (7, 'SELECT', 'payments_#'), (7, 'SELECT', 'visits_#'), (8, 'UPDATE', 'payments_#')) AS f(line, query_type, table_name)
"""
_COLUMNS = """
SELECT 'repo' || (p_partkey % 5) AS repo, 'src/Store' || p_partkey || '.java' AS path, line, replace(table_name, '#', p_partkey::VARCHAR) AS table_name, "columns" FROM part, (VALUES
  (7, 'payments_#', 'kind,level,note,status'), (7, 'visits_#', 'amount,level,note'), (8, 'payments_#', 'day,id,status')) AS f(line, table_name, "columns")
"""
ORACLES: dict[str, str] = {
    "all_usages": _ROWS,
    "column_usages": _COLUMNS,
    "usages_of_column": f"SELECT path, table_name, line FROM ({_COLUMNS}) WHERE list_contains(string_split(\"columns\", ','), 'status')",
}
