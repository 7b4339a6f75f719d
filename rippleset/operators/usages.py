"""Table and collection usages in source files beside quoted SQL: mapped entities, names that hint at a table, calls on collections; and the
columns that a statement reads or writes.

Each usage is ``repo, path, line, query_type, table_name``. Names are ASCII. Null contents have no usages. A table named by ``@Table`` counts
as an entity and as a table, so twice; each identifier that hints at a table counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleset.config import COLLECTION_STOP_WORDS, HEURISTIC_TABLES
from rippleset.operators.ddl import split_top_level
from rippleset.operators.schema_change import once, usages

# --- Fixed values: forms of the lines ---
ENTITY = (r"""@(?:Entity|Table)\s*\([^)]*name\s*=\s*["'](\w+)["']""", r"""@Table\s*\([^)]*name\s*=\s*["'](\w+)["']""", r"""__tablename__\s*=\s*["'](\w+)["']""")
_CALLS = "find|insertOne|insertMany|updateOne|updateMany|deleteOne|deleteMany|aggregate|findOne"
COLLECTION = (
    rf"(?i)db\.(\w+)\.(?:{_CALLS}|count|distinct|createIndex|dropIndex)", rf"""(?i)["'](\w+)["']\.(?:{_CALLS})""", r"""(?i)getCollection\s*\(["'](\w+)["']""",
    r"""(?i)collection\s*=\s*["'](\w+)["']""", r"""(?i)["']collection["']\s*:\s*["'](\w+)["']""", r"""(?i)\.collection\s*\(["'](\w+)["']""")
CLASS = r"(?i)class\s+(\w+)"
HINT = rf"(?i)\s(\w*(?:{'|'.join(word for word, _ in HEURISTIC_TABLES)})\w*)"
SOURCE = r"""(?i)\b(?:FROM|JOIN|UPDATE|INTO)\s+(?:[`"\\]*\w+[`"\\]*\.)*[`"\\]*(\w+)[`"\\]*(?:\s+(?:AS\s+)?(?!(?:WHERE|ON|SET|JOIN|LEFT|RIGHT|INNER|OUTER|CROSS|FULL|GROUP|ORDER|LIMIT|VALUES|SELECT|USING|HAVING|UNION)\b)(\w+))?"""
SELECTED, CONDITION, ASSIGNED = r"(?is)\bSELECT\s+(.*?)\s+FROM\b", r"(?is)\bWHERE\s+(.*?)(?:\s+(?:GROUP|ORDER|LIMIT|JOIN)\b|$)", r"(?is)\bSET\s+(.*?)(?:\s+WHERE\b|$)"
NAMED = r"((?:\w+\.)?[A-Za-z_]\w*)(?!\w)(?!\s*[(.])"
COMPARED = r"(?i)((?:\w+\.)?[A-Za-z_]\w*)\s*(?:[=<>!]|(?:NOT\s+)?(?:IN|LIKE|BETWEEN|IS)\b)"
NO_COLUMN = ("distinct", "case", "when", "then", "else", "end", "and", "or", "not", "null", "is", "in", "like", "between", "true", "false", "all", "over", "partition", "by", "order", "asc", "desc", "interval")
# ---


def _on_lines(content: Column, *patterns: str) -> Column:
    """``line, name`` of every match of the patterns' first group, line by line."""
    def hits(s: Column, i: Column) -> Column:
        found = F.concat(*(F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p in patterns))
        return F.transform(found, lambda name: F.struct((i + 1).alias("line"), name.alias("name")))

    some = content.rlike("|".join(f"(?:{p})" for p in patterns))
    return F.flatten(F.when(some, F.transform(F.split(content, "\n"), hits)))


def _exploded(files: DataFrame, hits: Column, kind: str) -> DataFrame:
    return files.select("repo", "path", F.inline(hits)).select("repo", "path", "line", F.lit(kind).alias("query_type"), F.col("name").alias("table_name"))


def entity_usages(files: DataFrame) -> DataFrame:
    """Tables that classes are mapped to."""
    return _exploded(files, _on_lines(F.col("content"), *ENTITY), "ORM_ENTITY")


def _hinted(name: Column) -> Column:
    out = None
    for word, table in HEURISTIC_TABLES:
        test = F.contains(F.lower(name), F.lit(word))
        out = F.when(test, table) if out is None else out.when(test, table)
    return out


def hinted_usages(files: DataFrame) -> DataFrame:
    """Tables that a line's class name, or an identifier after white space, hints at: the first known word in it."""
    def hits(s: Column, i: Column) -> Column:
        named = F.filter(F.array(F.regexp_extract(s, CLASS, 1)), lambda x: x != "")
        tables = F.transform(F.concat(named, F.regexp_extract_all(s, F.lit(HINT), F.lit(1))), _hinted)
        return F.transform(F.filter(tables, lambda t: t.isNotNull()), lambda t: F.struct((i + 1).alias("line"), t.alias("name")))

    some = F.col("content").rlike("(?i)" + "|".join(word for word, _ in HEURISTIC_TABLES))
    return _exploded(files, F.flatten(F.when(some, F.transform(F.split("content", "\n"), hits))), "HEURISTIC")


def collection_usages(files: DataFrame) -> DataFrame:
    """Collections of a document store that calls and settings name."""
    found = _exploded(files, _on_lines(F.col("content"), *COLLECTION), "MONGO_OPERATION")
    return found.where(~F.lower("table_name").isin(*COLLECTION_STOP_WORDS))


def all_usages(files: DataFrame, hints: bool = True) -> DataFrame:
    """The usages of all four kinds, names in lower case."""
    parts = [usages(files).drop("query"), entity_usages(files), collection_usages(files), *([hinted_usages(files)] if hints else [])]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("table_name", F.lower("table_name"))


def _named(query: Column) -> Column:
    """``sources`` (table, alias) of a statement, and the columns ``named`` in it (owner: what qualifies it, name)."""
    def read(bare: Column) -> Column:
        groups = lambda k: F.regexp_extract_all(bare, F.lit(SOURCE), F.lit(k))
        sources = F.transform(F.arrays_zip(groups(1).alias("table"), groups(2).alias("alias")), lambda x: F.struct(F.lower(x["table"]).alias("table"), F.lower(F.coalesce(x["alias"], F.lit(""))).alias("alias")))
        items = F.transform(split_top_level(F.regexp_extract(bare, SELECTED, 1)), lambda s: F.regexp_replace(s, r"(?i)\s+AS\s+\w+\s*$|(?<=[\w)])\s+\w+\s*$", ""))
        listed = F.flatten(F.transform(items, lambda s: F.regexp_extract_all(s, F.lit(NAMED), F.lit(1))))
        compared = F.regexp_extract_all(F.regexp_extract(bare, CONDITION, 1), F.lit(COMPARED), F.lit(1))
        assigned = F.regexp_extract_all(F.regexp_extract(bare, ASSIGNED, 1), F.lit(r"((?:\w+\.)?[A-Za-z_]\w*)\s*="), F.lit(1))
        columns = F.filter(F.array_distinct(F.transform(F.concat(listed, compared, assigned), F.lower)), lambda c: ~c.isin(*NO_COLUMN))
        parted = F.transform(columns, lambda c: F.struct(F.regexp_extract(c, r"^(\w+)\.", 1).alias("owner"), F.regexp_replace(c, r"^\w+\.", "").alias("name")))
        return F.struct(sources.alias("sources"), parted.alias("named"))

    return once(F.regexp_replace(F.regexp_replace(query, r"'[^']*'", " "), r"""[`"\\]""", ""), read)


def _columns_of(table: Column, read: Column) -> Column:
    """The columns in a statement (``_named``) that belong to a table."""
    aliases = F.transform(F.filter(read["sources"], lambda s: s["table"] == table), lambda s: s["alias"])
    mine = lambda known: F.filter(read["named"], lambda c: (c["owner"] == "") | (c["owner"] == table) | F.array_contains(known, c["owner"]))
    return once(aliases, lambda known: F.array_distinct(F.transform(mine(known), lambda c: c["name"])))


def query_columns(query: Column) -> Column:
    """``table_name, columns`` of every table in a statement: columns of its SELECT list, conditions and assignments.

    A qualified column belongs to the table of that name or alias, a bare one to every table. Strings, ``*``, functions and keywords are none.
    """
    tables = lambda read: F.array_distinct(F.transform(read["sources"], lambda s: s["table"]))
    return once(_named(query), lambda read: F.transform(tables(read), lambda table: F.struct(table.alias("table_name"), _columns_of(table, read).alias("columns"))))


def column_usages(found: DataFrame) -> DataFrame:
    """``repo, path, line, table_name, columns`` of the statements that ``usages`` found, each statement once a table."""
    is_source = lambda read: F.exists(read["sources"], lambda s: s["table"] == F.col("table_name"))
    own = once(_named(F.col("query")), lambda read: F.when(is_source(read), _columns_of(F.col("table_name"), read)))
    return found.select("repo", "path", "line", "table_name", F.coalesce(own, F.expr("cast(array() as array<string>)")).alias("columns"))


def usages_of_column(found: DataFrame, column: Column) -> DataFrame:
    """The usages (``columns``) that name a changed column, whatever its letter case; all of them where none was changed (null)."""
    return found.where(column.isNull() | F.exists("columns", lambda c: F.lower(c) == F.lower(column)))
