"""Schema-change risk: DDL classes, usages in code, relations, scores. Files stay whole in their rows; only hits are exploded."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleset.config import ScoringConfig

D = lambda x: F.lit(Decimal(str(x)))

# --- Fixed values: forms of the statements, in the order in which they are tried ---
NAME = r"""[`"]?(\w+)[`"]?"""
TABLE = r"""(?:[`"]?\w+[`"]?\.)?[`"]?(\w+)[`"]?"""
TYPE = r"(\w+(?:\s*\([^)]*\))?)"
ALTERED = rf"^ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?{TABLE}\b"
CLASSES = (
    ("DROP_TABLE", rf"^DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?{TABLE}"),
    ("ADD_INDEX", rf"^CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s+ON\s+{TABLE}"),
    ("DROP_INDEX", rf"^DROP\s+INDEX\s+(?:IF\s+EXISTS\s+)?{TABLE}(?:\s+ON\s+{TABLE})?"),
    ("SET_DEFAULT", rf"ALTER\s+(?:COLUMN\s+)?{NAME}\s+SET\s+DEFAULT\s+([^;]+)"),
    ("DROP_DEFAULT", rf"ALTER\s+(?:COLUMN\s+)?{NAME}\s+DROP\s+DEFAULT"),
    ("SET_NOT_NULL", rf"ALTER\s+(?:COLUMN\s+)?{NAME}\s+SET\s+NOT\s+NULL"),
    ("DROP_NOT_NULL", rf"ALTER\s+(?:COLUMN\s+)?{NAME}\s+DROP\s+NOT\s+NULL"),
    ("MODIFY_COLUMN", rf"(?:ALTER|MODIFY)\s+COLUMN\s+{NAME}\s+(?:(?:SET\s+DATA\s+)?TYPE\s+)?{TYPE}"),
    ("RENAME_COLUMN", rf"RENAME\s+COLUMN\s+{NAME}\s+TO\s+{NAME}"),
    ("ADD_CONSTRAINT", rf"ADD\s+CONSTRAINT\s+{NAME}"),
    ("DROP_CONSTRAINT", rf"DROP\s+CONSTRAINT\s+(?:IF\s+EXISTS\s+)?{NAME}"),
    ("ADD_COLUMN", rf"\bADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?{NAME}(?:\s+{TYPE})?"),
    ("DROP_COLUMN", rf"\bDROP\s+(?:COLUMN\s+)?(?:IF\s+EXISTS\s+)?{NAME}"),
    ("RENAME_TABLE", rf"RENAME\s+TO\s+{NAME}"),
    ("ALTER_TABLE", r"^ALTER\s+TABLE\b"),
)
#: Class, group of the table (0: the altered table), group of the column, group of the new value.
PLACES = {"DROP_TABLE": (1, 0, 0), "ADD_INDEX": (2, 1, 0), "DROP_INDEX": (2, 1, 0), "SET_DEFAULT": (0, 1, 2), "DROP_DEFAULT": (0, 1, 0), "SET_NOT_NULL": (0, 1, 0), "DROP_NOT_NULL": (0, 1, 0), "MODIFY_COLUMN": (0, 1, 2), "RENAME_COLUMN": (0, 1, 2),
          "ADD_CONSTRAINT": (0, 1, 0), "DROP_CONSTRAINT": (0, 1, 0), "ADD_COLUMN": (0, 1, 2), "DROP_COLUMN": (0, 1, 0), "RENAME_TABLE": (0, 0, 1), "ALTER_TABLE": (0, 0, 0)}
SQL_LITERAL = r'"((?i:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\b[^"]*)"'
_STATEMENT = r"(?i:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\b"
#: A quote that may open a statement (three quotes also at a line's end), and a statement from its mark to the same quote: on a line, or anywhere.
OPENING = rf"""(?:"{{3}}|'{{3}})(?=\s*(?:{_STATEMENT}|$))|["'](?={_STATEMENT})"""
LINE_LITERAL = rf"""\x01(\d+)\x02("{{3}}|'{{3}}|["'])({_STATEMENT}(?:(?!\2)[^\n])*+)\2"""
LITERAL = rf"""(?s)\x01(\d+)\x02("{{3}}|'{{3}}|["'])(\s*{_STATEMENT}(?:(?!\2).)*+)\2"""
#: The six call forms, either quote; the path is group 2.
CALL = r"""(?i)(?:fetch|(?:axios|fetch|http|requests)\.\w+|RestTemplate\.(?:get|post)For(?:Object|Entity)|@(?:Get|Post|Put|Delete|Patch)Mapping)\s*\((["'])(/(?:(?!\1).)*)\1"""
QUERY_TABLE = r"""(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+(?:[`"\\]*\w+[`"\\]*\.)*[`"\\]*(\w+)"""
#: Forms of a document store's operations.
STORE_FORMS = r"create collection|drop collection|createindex|dropindex|db\."
#: A FROM that names no table.
NO_SOURCE = r"(?i)\b(?:EXTRACT|TRIM|SUBSTRING|OVERLAY|POSITION)\s*\([^()]*\)|\bIS\s+(?:NOT\s+)?DISTINCT\s+FROM\b"
#: What an ADD names when it adds no column, and the kind of a constraint.
ADDED_KEY = r"\bADD\s+(?:PRIMARY|FOREIGN|UNIQUE|CHECK|CONSTRAINT|EXCLUDE)\b"
ADDED_INDEX = r"\bADD\s+(?:UNIQUE\s+)?(?:FULLTEXT\s+|SPATIAL\s+)?(?:INDEX|KEY)\s+"
DROPPED_INDEX = r"\bDROP\s+(?:INDEX|KEY)\s+"
INDEX_NAME = rf"\b(?:ADD\s+(?:UNIQUE\s+|FULLTEXT\s+|SPATIAL\s+)?|DROP\s+)(?:INDEX|KEY)\s+{NAME}"
DROPPED_KEY = r"\bDROP\s+(?:PRIMARY\s+KEY|FOREIGN\s+KEY|CHECK)\b"
KINDS = ("PRIMARY KEY", "FOREIGN KEY", "UNIQUE", "CHECK")
# ---


def classify(changes: DataFrame, statement: str = "statement") -> DataFrame:
    """``changes`` with ``change_type`` (null: not a change), ``table_name``, ``column_name``, ``new_value``, ``old_value``, in capitals.

    Words inside quotes don't count. All but indexes and whole tables are changed by ALTER TABLE only. Keys and checks that are added or dropped
    without a name are constraints; an added constraint's ``constraint_kind`` is told.
    """
    # Each found once a row: what a generator gives out is not copied into the filters and parts that use it.
    once = lambda x, name: F.explode(F.array(x)).alias(name)
    given = F.upper(F.regexp_replace(F.trim(F.col(statement)), r"\s*\.\.\.$", ""))
    prepared = changes.select("*", once(given, "_ddl_text")).select("*", once(F.regexp_replace("_ddl_text", "'[^']*'", "''"), "_ddl_bare"))
    text, bare = F.col("_ddl_text"), F.col("_ddl_bare")
    alters = bare.rlike(r"^ALTER\s+TABLE\b")
    guards = {
        "ADD_INDEX": lambda test: test | (alters & bare.rlike(ADDED_INDEX)), "DROP_TABLE": lambda test: test, "DROP_INDEX": lambda test: test | (alters & bare.rlike(DROPPED_INDEX)), "ALTER_TABLE": lambda test: test,
        "ADD_CONSTRAINT": lambda test: alters & (test | bare.rlike(ADDED_KEY)), "DROP_CONSTRAINT": lambda test: alters & (test | bare.rlike(DROPPED_KEY))}
    kind = None
    for name, pattern in CLASSES:
        test = guards.get(name, lambda test: alters & test)(bare.rlike(pattern))
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    typed = prepared.select("*", once(kind, "change_type"))  # the parts below try one pattern a row
    table = column = value = F.when(F.lit(False), F.lit(None).cast("string"))
    altered = F.nullif(F.regexp_extract(text, ALTERED, 1), F.lit(""))
    for name, pattern in CLASSES:
        at, col, val = PLACES[name]
        is_it, group = F.col("change_type") == name, lambda k, p=pattern: F.nullif(F.regexp_extract(text, p, k), F.lit(""))
        table = table.when(is_it, F.coalesce(F.coalesce(group(at), altered) if at else altered, F.lit("UNKNOWN")))
        column = column.when(is_it, group(col)) if col else column
        value = value.when(is_it, F.trim(group(val))) if val else value
    index = F.col("change_type").isin("ADD_INDEX", "DROP_INDEX") & alters
    column = F.when(index, F.nullif(F.regexp_extract(text, INDEX_NAME, 1), F.lit(""))).otherwise(column)
    added = F.col("change_type") == "ADD_CONSTRAINT"
    constraint = F.lit("CONSTRAINT")
    for name in reversed(KINDS):
        constraint = F.when(F.contains(bare, F.lit(name)), F.replace(F.lit(name), F.lit(" "), F.lit("_"))).otherwise(constraint)
    old = F.when(F.col("change_type") == "RENAME_COLUMN", column).when(F.col("change_type") == "RENAME_TABLE", table)
    return typed.select(*changes.columns, "change_type", table.alias("table_name"), column.alias("column_name"), value.alias("new_value"), old.alias("old_value"), F.when(added, constraint).alias("constraint_kind"))


def database_type(name: Column, explicit: Column | None = None, statement: Column | None = None) -> Column:
    """The type that is told, in small letters; else a document store by its name or by the form of a statement, else relational."""
    store = F.contains(F.lower(name), F.lit("mongo"))
    if statement is not None:
        store = store | F.lower(statement).rlike(STORE_FORMS)
    found = F.when(store, "mongodb").otherwise("postgresql")
    return found if explicit is None else F.coalesce(F.nullif(F.lower(explicit), F.lit("")), found)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _statements(content: Column) -> Column:
    """``line`` (where it begins) and ``query`` of every quoted statement, within a line or over several.

    Quotes that may open a statement are marked with the number of their line; then each statement is taken from its mark to the same quote,
    first those that end on their line, then those over several.
    """
    clean = F.translate(content, "\x01\x02", "  ")
    mark = lambda s, i: F.regexp_replace(s, F.lit(OPENING), F.concat(F.lit("\x01"), (i + 1).cast("string"), F.lit("\x02$0")))
    marked = F.array_join(F.transform(F.split(clean, "\n"), mark), "\n")

    def read(text: Column, pattern: str) -> Column:
        one = lambda x: F.struct(F.regexp_extract(x, r"^\x01(\d+)", 1).cast("int").alias("line"), F.regexp_replace(F.regexp_extract(x, pattern, 3), r"\x01\d+\x02", "").alias("query"))
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one)

    several = lambda text: F.filter(read(text, LITERAL), lambda x: F.contains(x["query"], F.lit("\n")))
    return F.when(content.rlike(rf"""["']\s*{_STATEMENT}"""), once(marked, lambda text: F.concat(read(text, LINE_LITERAL), several(text))))


def usages(files: DataFrame) -> DataFrame:
    """``repo, path, line, query_type, table_name, query`` of every table in a quoted statement, within a line or over several."""
    queries = files.select("repo", "path", F.inline(_statements(F.col("content"))))
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_replace("query", NO_SOURCE, " "), F.lit(QUERY_TABLE), F.lit(1)), F.lower))
    return queries.select("repo", "path", "line", query_type(F.col("query")).alias("query_type"), F.explode(found).alias("table_name"), "query")


def query_type(query: Column) -> Column:
    """First keyword of a query."""
    first = F.upper(F.regexp_extract(query, r"^\s*(\w+)", 1))
    return F.when(first.isin("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP"), first).otherwise("UNKNOWN")


def usage_summary(found: DataFrame) -> DataFrame:
    """Distinct files and usages of each table: one row a table, before any join with changes."""
    files = found.groupBy("table_name", "repo", "path").agg(F.count(F.lit(1)).alias("n"))
    return files.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_usages"))


def relation_counts(foreign_keys: DataFrame) -> DataFrame:
    """References of each table, out and in."""
    out = foreign_keys.groupBy(F.col("source_table").alias("table_name")).agg(F.count(F.lit(1)).alias("n_forward"))
    back = foreign_keys.groupBy(F.col("target_table").alias("table_name")).agg(F.count(F.lit(1)).alias("n_reverse"))
    both = out.join(back, "table_name", "full")
    return both.select("table_name", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_forward", "n_reverse")))


def steps(value: Column, *bounds: tuple[int, str]) -> Column:
    """Points of the first bound that a value is above, else 0."""
    out = None
    for bound, points in bounds:
        out = F.when(value > bound, D(points)) if out is None else out.when(value > bound, D(points))
    return out.otherwise(D("0.0"))


def ai_points(risks: Column, concerns: Column | None = None, config: ScoringConfig | None = None) -> Column:
    """Points of the number of risks that a reviewer named, and of regulatory concerns, at most 2."""
    points = steps(risks, (3, "1.5"), (1, "1.0"), (0, "0.5"))
    if concerns is None:
        return points
    none = F.lower(F.coalesce(concerns, F.lit(""))).isin("", *(config or ScoringConfig()).not_a_concern)
    return F.least(points + F.when(none, D("0.0")).otherwise(D("0.5")), D("2.0"))


def risk_level(score: Column, config: ScoringConfig | None = None) -> Column:
    """Level of an unrounded score."""
    config = config or ScoringConfig()
    out = None
    for bound, name, _ in config.levels:
        test = score >= D(bound)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(config.lowest_level[0])


def schema_change_risk(changes: DataFrame, found: DataFrame, foreign_keys: DataFrame, config: ScoringConfig | None = None) -> DataFrame:
    """Scored changes: each change meets one summary row of its table's usages and one of its relations."""
    config = config or ScoringConfig()
    named = classify(changes).where("change_type is not null").withColumn("_table", F.lower("table_name"))
    joined = named.join(usage_summary(found).withColumnRenamed("table_name", "_table"), "_table", "left").join(relation_counts(foreign_keys).withColumnRenamed("table_name", "_table"), "_table", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    files, used, forward, reverse = (zero(c) for c in ("n_files", "n_usages", "n_forward", "n_reverse"))
    critical = F.when(F.col("_table").rlike("|".join(config.critical_table_words)), D("2.5")).otherwise(D("1.5")) + steps(forward + reverse, (5, "0.5"), (2, "0.3"))
    code = steps(files, (10, "3.0"), (5, "2.0"), (2, "1.5"), (0, "1.0")) + F.when(F.col("column_name").isNotNull() & (used > 20), D("0.5")).otherwise(D("0.0"))
    relations = steps(reverse, (5, "2.0"), (2, "1.5"), (0, "1.0")) + steps(forward, (3, "0.5"))
    parts = joined.select("event_id", "change_type", F.col("_table").alias("table_name"), files.alias("n_files"), F.least(critical, D("3.0")).alias("_critical"), F.least(code, D("3.0")).alias("_code"), F.least(relations, D("2.0")).alias("_relations"), F.least(ai_points(F.col("ai_risks")), D("2.0")).alias("_ai"))
    score = F.least((F.col("_critical") + F.col("_code") + F.col("_relations") + F.col("_ai")) * D(config.schema_scale), D(config.cap)).cast("decimal(6,4)")
    scored = parts.select("event_id", "change_type", "table_name", "n_files", score.alias("score"))
    return scored.withColumn("level", risk_level(F.col("score"), config))


def temporal_multiplier(ts: Column) -> Column:
    """Factor of the moment: Friday from 14:00, the month's end, a quarter's end; at most 2."""
    friday = F.when((F.dayofweek(ts) == 6) & (F.hour(ts) >= 14), D("1.3")).otherwise(D("1.0"))
    late = F.dayofmonth(ts) >= 28
    end = F.when(late & F.month(ts).isin(3, 6, 9, 12), D("1.80")).when(late, D("1.20")).otherwise(D("1.00"))
    return F.least(friday * end, D("2.0")).cast("decimal(4,2)")


def file_criticality(path: Column, config: ScoringConfig | None = None) -> Column:
    """Class of a file by words in its path."""
    config = config or ScoringConfig()
    return F.when(F.lower(path).rlike("|".join(config.critical_file_words)), "CRITICAL").when(F.lower(path).rlike("|".join(config.high_file_words)), "HIGH").otherwise("MEDIUM")


def contract_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each endpoint's change: removed ones, other types or more required parameters break, fewer modify, new ones add.

    A missing return type says nothing. Of repeated endpoints the last one counts, by ``line`` if there is one. ``diff_contracts`` compares
    parameters by name and finds moved paths.
    """
    place = lambda df: F.col("line") if "line" in df.columns else F.struct("return_type", "required_params")
    last = lambda df: df.groupBy("method", "path").agg(F.max_by(F.struct("change_set", "return_type", "required_params"), place(df)).alias("of"))
    a, b = last(before).withColumnRenamed("of", "a"), last(after).withColumnRenamed("of", "b")
    joined = a.join(b, ["method", "path"], "full")
    kind = (
        F.when(F.col("b").isNull(), "BREAKING").when(F.col("a").isNull(), "ADDED").when(F.col("a.return_type") != F.col("b.return_type"), "BREAKING")
        .when(F.col("b.required_params") > F.col("a.required_params"), "BREAKING").when(F.col("b.required_params") < F.col("a.required_params"), "MODIFIED"))
    return joined.select("method", "path", F.coalesce("a.change_set", "b.change_set").alias("change_set"), kind.alias("change")).where("change is not null")


def contract_score(changes: DataFrame, consumers: DataFrame) -> DataFrame:
    """Score of each change set: points of its changes, raised by the number of consumers of changed paths (in any letter case), at most 10."""
    points = F.when(F.col("change") == "BREAKING", D("3.0")).when(F.col("change") == "MODIFIED", D("1.5")).otherwise(D("0.5"))
    used = changes.withColumn("path", F.lower("path")).join(consumers.groupBy(F.lower("path").alias("path")).agg(F.count(F.lit(1)).alias("n")), "path", "left")
    sums = used.groupBy("change_set").agg(F.sum(points).alias("points"), F.sum(F.coalesce("n", F.lit(0))).alias("consumers"))
    factor = F.when(F.col("consumers") > 10, D("1.5")).when(F.col("consumers") > 5, D("1.3")).when(F.col("consumers") > 0, D("1.1")).otherwise(D("1.0"))
    return sums.select("change_set", "consumers", F.least(F.col("points") * factor, D(10)).cast("decimal(6,2)").alias("score"))


def call_sites(files: DataFrame) -> DataFrame:
    """Every call of an API path in the lines of every file."""
    lines = F.transform(F.split("content", "\n"), lambda s, i: F.struct((i + 1).alias("line"), F.regexp_extract_all(s, F.lit(CALL), F.lit(2)).alias("paths")))
    hits = files.select("repo", F.col("path").alias("file"), F.inline(F.filter(lines, lambda x: F.size(x["paths"]) > 0)))
    return hits.select("repo", "file", "line", F.explode("paths").alias("path"))
