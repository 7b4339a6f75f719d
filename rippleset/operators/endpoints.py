"""API endpoints declared in source files, of four web frameworks and in plain ``METHOD /path`` lines.

A file is cut at the marks that begin a declaration (an annotation, a decorator, a route call), each piece carrying the number of its
line. A piece is read on its own with patterns that follow brackets and strings to the end of the signature, however many lines it
takes, so the work grows with the file and not with its square. All of it are column expressions on the file's row.

Decisions: the path of an annotation is its first string, or that of ``value`` or ``path``. All parameters of a signature are returned. The first
``@RequestMapping`` path of a file is the base of its others. A parameter's type ends before its default. Names are ASCII. Plain lines need a
whole word as method. Comments inside a declaration are skipped, a declaration that is itself a comment counts. Null contents have no endpoints; brackets nested deeper than five end a signature unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleset.config import HTTP_METHODS

_STRING = r""""[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"""


def _nested(opening: str, closing: str, depth: int = 5) -> str:
    """A bracket with all that it holds: strings, text, and brackets of its kind."""
    plain = rf"""[^{opening}{closing}"']++|{_STRING}"""
    out = f"{opening}(?:{plain})*+{closing}"
    for _ in range(depth - 1):
        out = f"{opening}(?:{plain}|{out})*+{closing}"
    return f"(?:{out})"


ARGUMENTS, ANGLES, SQUARES = _nested(r"\(", r"\)"), r"(?:<[^<>]*+(?:<[^<>]*+(?:<[^<>]*+>[^<>]*+)*+>[^<>]*+)*+>)", _nested(r"\[", r"\]")
#: One argument: all up to a comma outside brackets and strings.
ARGUMENT = rf"""((?:[^,()\[\]<>"']++|{_STRING}|{ARGUMENTS}|{SQUARES}|{ANGLES}|[<>])++)"""

# --- Fixed values: forms of the declarations ---
VERBS = "|".join(m.capitalize() for m in HTTP_METHODS)
SPRING = rf"@(?:{VERBS})Mapping\b"
FLASK = r"@(?:app|blueprint|router)\.route\b"
FASTAPI = rf"(?i)@(?:app|router)\.(?:{'|'.join(HTTP_METHODS)})\b"
EXPRESS = rf"""(?i)\b(?:router|app)\.(?:{"|".join(HTTP_METHODS)})\s*\(\s*["'`]"""
GENERIC = rf"""(?i)\b(?:{"|".join(HTTP_METHODS)})\s+["']?/"""
BASE = r"""@RequestMapping\s*\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*["']([^"']*)"""
NAMED_PATH = r"""\b(?:value|path)\s*=\s*\{?\s*["']([^"']*)"""
FIRST_PATH = r"""^\(\s*\{?\s*["'`]([^"'`]*)"""
JAVA_NOTE = rf"@\w+(?:\s*{ARGUMENTS})?"
JAVA_METHOD = rf"^\d+\x02{JAVA_NOTE}\s*+(?:{JAVA_NOTE}\s*+)*+(?:(?:public|protected|private|static|final|default|abstract|synchronized)\s++)*+([\w.]++(?:\s*{ANGLES})?(?:\[\])*+)\s+\w+\s*({ARGUMENTS})"
PYTHON_DEF = rf"\bdef\s+\w+\s*({ARGUMENTS})(?:\s*->\s*([^:]+))?"
#: Comments after a start, beside the strings that are kept.
JAVA_COMMENT = r"""("(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')|//[^\n]*|/\*(?s:.*?)\*/"""
PYTHON_COMMENT = r"""("(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')|\x23[^\n]*"""
PARAMETER_NOTE = r"@(RequestParam|RequestBody|PathVariable)\b"
QUERY_TYPES = ("str", "int", "float", "bool")
# ---

PARAMETERS = "array<struct<name: string, type: string, required: boolean, location: string>>"
_MARK, _END = "\x01", "\x02"


def framework(path: Column, content: Column) -> Column:
    """Web framework of a file, the first that fits."""
    name, text = F.lower(path), F.lower(content)
    script = name.endswith(".js") | name.endswith(".ts")
    return (
        F.when(name.endswith(".java") & (F.contains(content, F.lit("@RestController")) | F.contains(content, F.lit("@Controller"))), "spring_boot")
        .when(name.endswith(".py") & (F.contains(text, F.lit("from flask import")) | F.contains(text, F.lit("@app.route"))), "flask")
        .when(name.endswith(".py") & (F.contains(text, F.lit("from fastapi import")) | F.contains(content, F.lit("FastAPI"))), "fastapi")
        .when(script & (F.contains(text, F.lit("express")) | F.contains(text, F.lit("router."))), "express")
        .otherwise("generic"))


def joined_path(base: Column, path: Column) -> Column:
    """A base path and a path under it, with single slashes; either alone stays as it is."""
    strip = lambda c: F.regexp_replace(c, "^/+|/+$", "")
    parts = F.filter(F.array(strip(base), strip(path)), lambda x: x != "")
    return F.when(F.coalesce(base, F.lit("")) == "", path).when(path == "", base).otherwise(F.concat(F.lit("/"), F.array_join(parts, "/")))


def _pieces(content: Column, start: str) -> Column:
    """The text from each start to the next, after the number of its line."""
    clean = F.translate(content, _MARK + _END, "  ")
    mark = lambda s, i: F.regexp_replace(s, F.lit(f"({start})"), F.concat(F.lit(_MARK), (i + 1).cast("string"), F.lit(_END + "$1")))
    cut = F.split(F.array_join(F.transform(F.split(clean, "\n"), mark), "\n"), _MARK)
    return F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0)))


def _inside(arguments: Column) -> Column:
    """The arguments between a pair of brackets, one by one, trimmed."""
    inner = F.substring(arguments, F.lit(2), F.greatest(F.length(arguments) - 2, F.lit(0)))
    return F.filter(F.transform(F.regexp_extract_all(inner, F.lit(ARGUMENT), F.lit(1)), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^ | $", "")), lambda x: x != "")


def _parameter(name: Column, kind: Column, required: Column, location: Column) -> Column:
    return F.struct(name.alias("name"), kind.alias("type"), required.alias("required"), location.alias("location"))


def _java_parameters(arguments: Column) -> Column:
    noted = F.filter(_inside(arguments), lambda x: x.rlike(PARAMETER_NOTE))

    def one(x: Column) -> Column:
        note = F.regexp_extract(x, PARAMETER_NOTE, 1)
        bare = F.regexp_replace(F.trim(F.regexp_replace(x, JAVA_NOTE, "")), r"^final\s+", "")
        location = F.when(note == "RequestBody", "body").when(note == "RequestParam", "query").otherwise("path")
        required = (note == "PathVariable") | ~x.rlike(r"\brequired\s*=\s*false\b")
        return _parameter(F.regexp_extract(bare, r"(\w+)$", 1), F.trim(F.regexp_extract(bare, r"^(.*\S)\s+\w+$", 1)), required, location)

    return F.transform(noted, one)


def _python_parameters(arguments: Column, typed: bool) -> Column:
    def one(x: Column) -> Column:
        kind = F.trim(F.regexp_extract(x, r"^[^:=]*:\s*([^=]*)", 1)) if typed else F.lit("any")
        location = F.when(kind.isin(*QUERY_TYPES), "query").otherwise("body") if typed else F.lit("query")
        return _parameter(F.regexp_extract(x, r"^([^:=\s]+)", 1), kind, ~F.contains(x, F.lit("=")), location)

    given = F.filter(_inside(arguments), lambda x: x.rlike(r"^[^=]*:") if typed else (x != "self"))
    return F.transform(given, one)


def endpoints(files: DataFrame, keys: tuple[str, ...] = ("repo", "path"), kind: Column | None = None) -> DataFrame:
    """``keys, line, framework, method, api_path, return_type, params`` of every declared endpoint of ``files`` (path, content).

    ``kind`` says a file's framework where its content can't, as for a part of a file.
    """
    kind, text = framework(F.col("path"), F.col("content")) if kind is None else kind, F.col("content")
    starts = {"spring_boot": SPRING, "flask": FLASK, "fastapi": FASTAPI, "express": EXPRESS, "generic": GENERIC}
    pieces = None
    for name, start in starts.items():  # a file without a start is not cut into lines
        found = F.when(text.rlike(start), _pieces(text, start))
        pieces = F.when(F.col("framework") == name, found) if pieces is None else pieces.when(F.col("framework") == name, found)
    base = F.when(F.col("framework") == "spring_boot", F.regexp_extract(text, BASE, 1))
    cut = files.withColumn("framework", kind).select(*keys, "framework", base.alias("base"), F.explode(pieces).alias("piece"))
    of = F.col("framework")
    bare = F.when(of == "spring_boot", F.regexp_replace("piece", JAVA_COMMENT, "$1")).when(of.isin("flask", "fastapi"), F.regexp_replace("piece", PYTHON_COMMENT, "$1"))
    cut = cut.withColumn("piece", F.coalesce(bare, "piece"))
    piece = F.col("piece")
    arguments = F.regexp_extract(piece, rf"^\d+{_END}@[\w.]+\s*({ARGUMENTS})", 1)
    named, first = F.regexp_extract(arguments, NAMED_PATH, 1), F.regexp_extract(arguments, FIRST_PATH, 1)
    listed = F.regexp_extract_all(F.regexp_extract(arguments, r"\bmethods\s*=\s*[\[(]([^\])]*)", 1), F.lit(r"""["'](\w+)["']"""), F.lit(1))
    verb = F.regexp_extract(piece, rf"(?i)^\d+{_END}@?(?:\w+\.)?({'|'.join(HTTP_METHODS)})", 1)
    methods = F.when((of == "flask") & (F.size(listed) > 0), listed).when(of == "flask", F.array(F.lit("GET"))).otherwise(F.array(verb))
    path = (
        F.when(of == "spring_boot", joined_path(F.col("base"), F.when(first != "", first).otherwise(named)))
        .when(of == "express", F.regexp_extract(piece, r"""\(\s*["'`]([^"'`]*)""", 1))
        .when(of == "generic", F.regexp_extract(piece, r"""\s["']?(/[^"'\s]*)""", 1)).otherwise(first))
    none = F.expr(f"cast(array() as {PARAMETERS})")
    # Extracting groups from all pieces would read each signature five times: only the framework's own pattern is tried.
    signature = F.when(of == "spring_boot", F.regexp_extract(piece, JAVA_METHOD, 2)).when(of.isin("flask", "fastapi"), F.regexp_extract(piece, PYTHON_DEF, 1))
    returned = F.when(of == "spring_boot", F.regexp_extract(piece, JAVA_METHOD, 1)).when(of == "fastapi", F.regexp_extract(piece, PYTHON_DEF, 2))
    read = cut.select(
        *keys, F.regexp_extract(piece, r"^(\d+)", 1).cast("int").alias("line"), "framework", F.explode(methods).alias("method"), path.alias("api_path"),
        F.nullif(F.trim(F.regexp_replace(returned, r"\s+", " ")), F.lit("")).alias("return_type"), signature.alias("signature"))
    params = (
        F.when(of == "spring_boot", _java_parameters(F.col("signature"))).when(of == "flask", _python_parameters(F.col("signature"), False))
        .when(of == "fastapi", _python_parameters(F.col("signature"), True))
        .when(of == "express", F.transform(F.regexp_extract_all("api_path", F.lit(r":(\w+)"), F.lit(1)), lambda x: _parameter(x, F.lit("string"), F.lit(True), F.lit("path")))))
    return read.select(*keys, "line", "framework", F.upper("method").alias("method"), "api_path", "return_type", F.coalesce(params.cast(PARAMETERS), none).alias("params"))


def shown(params: Column) -> Column:
    """Parameters as one string, ``name:type:required:location`` each."""
    return F.array_join(F.transform(params, lambda p: F.concat_ws(":", p["name"], p["type"], p["required"].cast("string"), p["location"])), ";")
