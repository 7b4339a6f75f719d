"""Table definitions out of DDL texts, and the references between all tables defined anywhere.

A text is cut into statements outside quotes and comments, a table's body at its commas outside brackets and quotes. Names lose their quotes
and schema; they are compared in lower case. Column types keep their brackets. References are read from FOREIGN KEY clauses (several
columns give a row each) and from columns' own REFERENCES. Null texts hold no statement; an unclosed quote ends a statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleset.operators.endpoints import ARGUMENTS

# --- Fixed values: forms of the statements ---
QUOTED = r"""'[^']*+'|"[^"]*+"|`[^`]*+`"""
COMMENT = rf"({QUOTED})|--[^\n]*|/\*(?s:.*?)\*/"
STATEMENT = rf"((?:[^;'\"`]++|{QUOTED})++)"
PART = rf"""((?:[^,()'"`]++|{QUOTED}|{ARGUMENTS})++)"""
NAME = r"""[`"]?(\w+)[`"]?"""
QUALIFIED = rf"""(?:[`"]?\w+[`"]?\s*\.\s*)*{NAME}"""
TABLE = rf"(?is)^\s*CREATE\s+(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{QUALIFIED}\s*\((.*)\)[^)]*$"
NO_COLUMN = r"(?i)^(?:CONSTRAINT|INDEX|KEY|UNIQUE|FOREIGN\s+KEY|PRIMARY\s+KEY|CHECK|EXCLUDE|FULLTEXT)\b(?!\s+(?:VAR)?CHAR|\s+INT|\s+TEXT)"
COLUMN = rf"(?is)^{NAME}\s+(\w+(?:\s*\([^)]*\))?)\s*(.*)$"
DEFAULT = r"(?is)\bDEFAULT\s+('[^']*'|[^\s,]+)"
INDEX = rf"(?is)^(?:UNIQUE\s+)?(?:INDEX|KEY)\s*{NAME.replace('+)', '*)')}\s*\(([^)]+)\)"
FOREIGN_KEY = rf"(?is)\bFOREIGN\s+KEY\s*\(([^)]+)\)\s*REFERENCES\s+{QUALIFIED}\s*\(([^)]+)\)"
REFERENCES = rf"(?is)\bREFERENCES\s+{QUALIFIED}\s*\(([^)]+)\)"
# ---


def read_ddl(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of every ``.sql`` file under a folder."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.sql")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def statements(text: Column) -> Column:
    """The statements of a text, without comments, trimmed."""
    clean = F.regexp_replace(text, COMMENT, "$1")
    return F.filter(F.transform(F.regexp_extract_all(clean, F.lit(STATEMENT), F.lit(1)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def split_top_level(text: Column) -> Column:
    """The parts between the commas that stand outside brackets and quotes, trimmed, without empty ones."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(PART), F.lit(1)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def _names(listed: Column) -> Column:
    return F.transform(F.split(listed, ","), lambda s: F.regexp_replace(s, r"""^[\s`"]+|[\s`"]+$""", ""))


def table_definitions(files: DataFrame) -> DataFrame:
    """``path, table_name, columns, indexes, foreign_keys`` of every CREATE TABLE in ``files`` (path, content)."""
    found = files.select("path", F.explode(F.filter(statements(F.col("content")), lambda s: s.rlike(TABLE))).alias("statement"))
    parted = found.select("path", F.regexp_extract("statement", TABLE, 1).alias("table_name"), split_top_level(F.regexp_extract("statement", TABLE, 2)).alias("parts"))

    def column(part: Column) -> Column:
        rest = F.regexp_extract(part, COLUMN, 3)
        return F.struct(
            F.regexp_extract(part, COLUMN, 1).alias("name"), F.regexp_extract(part, COLUMN, 2).alias("type"), (~rest.rlike(r"(?i)\bNOT\s+NULL\b")).alias("nullable"),
            F.nullif(F.regexp_extract(rest, DEFAULT, 1), F.lit("")).alias("default_value"), rest.rlike(r"(?i)\bPRIMARY\s+KEY\b").alias("primary_key"))

    is_column = lambda p: ~p.rlike(NO_COLUMN) & p.rlike(COLUMN)
    key = lambda own, table, other: F.struct(own.alias("column"), table.alias("references_table"), other.alias("references_column"))

    def keys(part: Column) -> Column:
        pairs = F.arrays_zip(_names(F.regexp_extract(part, FOREIGN_KEY, 1)).alias("own"), _names(F.regexp_extract(part, FOREIGN_KEY, 3)).alias("other"))
        of_clause = F.transform(pairs, lambda z: key(z["own"], F.regexp_extract(part, FOREIGN_KEY, 2), z["other"]))
        of_column = F.array(key(F.regexp_extract(part, COLUMN, 1), F.regexp_extract(part, REFERENCES, 1), F.element_at(_names(F.regexp_extract(part, REFERENCES, 2)), 1)))
        return F.when(part.rlike(FOREIGN_KEY), of_clause).otherwise(of_column)

    index = lambda p: F.concat(F.coalesce(F.nullif(F.regexp_extract(p, INDEX, 1), F.lit("")), F.lit("unnamed")), F.lit("("), F.regexp_extract(p, INDEX, 2), F.lit(")"))
    refers = lambda p: p.rlike(FOREIGN_KEY) | (is_column(p) & p.rlike(REFERENCES))
    return parted.select(
        "path", "table_name", F.transform(F.filter("parts", is_column), column).alias("columns"),
        F.transform(F.filter("parts", lambda p: p.rlike(INDEX)), index).alias("indexes"), F.flatten(F.transform(F.filter("parts", refers), keys)).alias("foreign_keys"))


def foreign_keys(tables: DataFrame) -> DataFrame:
    """``source_table, target_table, column, references_column`` of every reference, tables in lower case."""
    return tables.select(F.lower("table_name").alias("source_table"), F.inline("foreign_keys")).select("source_table", F.lower("references_table").alias("target_table"), "column", "references_column")


def table_relationships(tables: DataFrame) -> DataFrame:
    """``table_name, type, other_table, column, references_column``: what each defined table refers to, and what refers to it."""
    end = lambda a, b, kind: F.struct(F.col(a).alias("table_name"), F.lit(kind).alias("type"), F.col(b).alias("other_table"), "column", "references_column")
    out, back = end("source_table", "target_table", "FOREIGN_KEY"), end("target_table", "source_table", "REFERENCED_BY")
    both = foreign_keys(tables).select(F.inline(F.when(F.col("source_table") == F.col("target_table"), F.array(out)).otherwise(F.array(out, back)))).distinct()
    return both.join(tables.select(F.lower("table_name").alias("table_name")).distinct(), "table_name", "left_semi")
