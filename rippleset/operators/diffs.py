"""Contract changes read out of unified diffs: the text on both sides, its endpoints, and what the changed lines say by themselves.

A diff is one row (``change_id, path, diff``) and stays one: its lines are an array, its sides are texts, and only what is found in them
becomes rows. Lines count from the first ``@@`` on where a diff has one and ``require_hunk`` is set; headers never count. A null diff has no
lines. The endpoints of a side are read as those of a file; a Java part without its class counts as a controller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleset.config import API_DIFF_WORDS, API_PATH_WORDS
from rippleset.operators.contracts import diff_contracts, masked_paths
from rippleset.operators.endpoints import EXPRESS, FASTAPI, FLASK, SPRING, endpoints, framework

# --- Fixed values: forms of the lines ---
HEADER = r"^(?:@@|diff --git|index |---|\+\+\+)"
NOTE = r"""(?i)@(Get|Post|Put|Delete|Patch|Request)Mapping\b(?:\s*\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*["']([^"']*))?"""
MAPPING = r"""@(\w+Mapping)\s*\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*["']([^"']+)"""
ADDED_PARAMETER = r"@RequestParam\s*(?:\([^)]*\)\s*)?(?:final\s+)?[\w.<>]+\s+(\w+)"
RESPONSE = r"ResponseEntity<(\w+)>"
#: Lines after a removed signature in which the added one is looked for.
NEAR = 4
# ---


def diff_lines(diff: Column, require_hunk: bool = False) -> Column:
    """``pos, kind, text`` of the context, removed and added lines of a diff, in order; ``pos`` from 1."""
    lines = F.split(diff, "\n")
    first = F.array_position(F.transform(lines, lambda s: s.startswith("@@")), True)
    kind = lambda s: F.when(s.startswith(" "), "context").when(s.startswith("-"), "removed").when(s.startswith("+"), "added")
    numbered = F.transform(lines, lambda s, i: F.struct((i + 1).alias("pos"), kind(s).alias("kind"), F.substring(s, F.lit(2), F.length(s)).alias("text"), s.rlike(HEADER).alias("header")))
    counts = lambda x: x["kind"].isNotNull() & ~x["header"] & ((first > 0) & (x["pos"] > first) if require_hunk else F.lit(True))
    return F.transform(F.filter(numbered, counts), lambda x: F.struct(x["pos"], x["kind"], x["text"]))


def explode_diff(diffs: DataFrame, require_hunk: bool = False) -> DataFrame:
    """A row for each context, removed and added line."""
    return diffs.select("change_id", F.inline(diff_lines(F.col("diff"), require_hunk)))


def diff_sides(diffs: DataFrame, require_hunk: bool = False) -> DataFrame:
    """``change_id, path, before, after``: the two texts that a diff stands between."""
    lines = diffs.select("change_id", "path", diff_lines(F.col("diff"), require_hunk).alias("lines"))
    side = lambda other: F.array_join(F.transform(F.filter("lines", lambda x: x["kind"] != other), lambda x: x["text"]), "\n")
    return lines.select("change_id", "path", side("added").alias("before"), side("removed").alias("after"))


def contracts_of_side(sides: DataFrame, side: str) -> DataFrame:
    """``change_id, method, path, line, return_type, params`` of the endpoints on one side."""
    text, name = F.col(side), F.lower("path")
    known = framework(F.col("path"), text)
    part = (
        F.when(known != "generic", known).when(name.endswith(".java") & text.rlike(SPRING), "spring_boot").when(name.endswith(".py") & text.rlike(FLASK), "flask")
        .when(name.endswith(".py") & text.rlike(FASTAPI), "fastapi").when(name.rlike(r"\.[jt]s$") & text.rlike(EXPRESS), "express").otherwise("generic"))
    found = endpoints(sides.withColumn("content", text), ("change_id",), part)
    return found.select("change_id", "method", F.col("api_path").alias("path"), "line", "return_type", "params")


def is_api_change(path: Column, diff: Column) -> Column:
    """Whether a change touches an API: by words of its path, or of its diff."""
    said = F.exists(F.array(*map(F.lit, API_DIFF_WORDS)), lambda w: F.contains(F.lower(diff), w))
    named = F.exists(F.array(*map(F.lit, API_PATH_WORDS)), lambda w: F.contains(F.lower(path), w))
    return F.coalesce(named, F.lit(False)) | F.coalesce(said, F.lit(False))


def _noted(diff: Column) -> Column:
    """``method, suffix`` of every mapping annotation in a diff."""
    pairs = F.arrays_zip(F.regexp_extract_all(diff, F.lit(NOTE), F.lit(1)).alias("method"), F.regexp_extract_all(diff, F.lit(NOTE), F.lit(2)).alias("suffix"))
    return F.array_distinct(F.transform(pairs, lambda x: F.struct(F.upper(x["method"]).alias("method"), _bare(F.coalesce(x["suffix"], F.lit(""))).alias("suffix"))))


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, "^/+|/+$", "")


def _stands(noted: Column, method: Column, path: Column) -> Column:
    """Whether one of the annotations is that of an endpoint: its method, and the end of its path or, without a path, two segments at most."""
    bare = _bare(path)
    short = F.size(F.split(bare, "/")) <= 2
    return F.exists(noted, lambda n: (n["method"] == F.upper(method)) & F.when(n["suffix"] == "", short).otherwise((bare == n["suffix"]) | F.endswith(bare, F.concat(F.lit("/"), n["suffix"]))))


def endpoints_in_diff(diffs: DataFrame, contracts: DataFrame) -> DataFrame:
    """Distinct ``change_id, method, path`` of the contracts whose annotation stands in the change's diff."""
    noted = diffs.select("change_id", _noted(F.col("diff")).alias("noted")).where(F.size("noted") > 0)
    return contracts.select("change_id", "method", "path").distinct().join(noted, "change_id").where(_stands(F.col("noted"), F.col("method"), F.col("path"))).select("change_id", "method", "path")


def diff_signs(diffs: DataFrame) -> DataFrame:
    """``change_id, diff, noted, required, moved, responses`` of every diff: what its lines say by themselves.

    ``noted``: methods and paths of its annotations. ``required``: names of added required request parameters. ``moved``: old and new path of annotations of one kind whose paths differ in a
    segment, or hold one another with at most one segment more. ``responses``: types that took the place of ``ResponseEntity<?>``.
    """
    lines = diffs.select("change_id", "diff", diff_lines(F.col("diff")).alias("lines"))
    added = F.filter("lines", lambda x: (x["kind"] == "added") & F.contains(x["text"], F.lit("@RequestParam")))
    given = F.flatten(F.transform(added, lambda x: F.regexp_extract_all(x["text"], F.lit(ADDED_PARAMETER), F.lit(0))))
    required = F.transform(F.filter(given, lambda x: ~x.rlike(r"\brequired\s*=\s*false\b")), lambda x: F.regexp_extract(x, ADDED_PARAMETER, 1))

    def mappings(kind: str) -> Column:
        of = F.filter("lines", lambda x: (x["kind"] == kind) & x["text"].rlike(MAPPING))
        found = F.transform(of, lambda x: F.struct(F.regexp_extract(x["text"], MAPPING, 1).alias("note"), F.regexp_extract(x["text"], MAPPING, 2).alias("path")))
        return F.transform(found, lambda m: F.struct(m["note"], m["path"], _bare(m["path"]).alias("bare"), masked_paths(m["path"]).alias("masked")))

    similar = lambda a, b: F.exists(a, lambda x: F.exists(b, lambda y: (x["key"] == y["key"]) & (x["hole"] != y["hole"])))
    nested = lambda a, b: (F.contains(a["bare"], b["bare"]) | F.contains(b["bare"], a["bare"])) & (a["bare"] != b["bare"]) & (F.abs(F.size(a["masked"]) - F.size(b["masked"])) <= 1)
    moved = F.flatten(F.transform("_old", lambda a: F.transform(
        F.filter("_new", lambda b: (a["note"] == b["note"]) & (similar(a["masked"], b["masked"]) | nested(a, b))), lambda b: F.struct(a["path"].alias("old_path"), b["path"].alias("new_path")))))

    new_type = lambda x: (x["kind"] == "added") & x["text"].rlike(RESPONSE)
    signed = F.filter("lines", lambda x: (x["kind"] == "removed") & F.contains(x["text"], F.lit("ResponseEntity<?>")))
    # What follows a line within a few places; lines were numbered in the whole diff, so headers between them count.
    after = lambda x: F.filter("lines", lambda y: new_type(y) & (y["pos"] > x["pos"]) & (y["pos"] <= x["pos"] + NEAR))
    types = F.transform(signed, lambda x: F.regexp_extract(F.get(after(x), F.lit(0))["text"], RESPONSE, 1))
    found = lines.select("change_id", "diff", _noted(F.col("diff")).alias("noted"), required.alias("required"), mappings("removed").alias("_old"), mappings("added").alias("_new"), F.array_distinct(F.filter(types, lambda t: t.isNotNull() & (t != ""))).alias("responses"))
    return found.select("change_id", "diff", "noted", "required", moved.alias("moved"), "responses")


def escalate(changes: DataFrame, diffs: DataFrame, before: DataFrame, consumers: DataFrame | None = None) -> DataFrame:
    """``changes`` with those made breaking that the diff's own lines show to break.

    New required parameters and moved paths count only where the change has no contract in ``before``; other responses always do. Only
    endpoints that stand in the diff are looked at, if any do. ``consumers`` (``path`` of calls) adds to the reason.
    """
    called = consumers.select(F.lower("path").alias("_endpoint"), F.lit(True).alias("called")).distinct() if consumers is not None else None
    joined = changes.join(diff_signs(diffs), "change_id", "left").withColumn("present", F.coalesce(_stands(F.col("noted"), F.col("method"), F.col("endpoint")), F.lit(False)))
    joined = joined.withColumn("some", F.max("present").over(Window.partitionBy("change_id")))
    joined = joined.join(before.select("change_id", F.lit(True).alias("known")).distinct(), "change_id", "left")
    joined = joined.join(called, F.lower("endpoint") == F.col("_endpoint"), "left") if called is not None else joined.withColumn("called", F.lit(False))
    text, bare = F.lower("diff"), _bare(F.col("endpoint"))
    named = F.contains(text, F.lower("endpoint")) | F.contains(text, F.lower("method"))
    hits = F.filter("moved", lambda m: F.contains(bare, _bare(m["new_path"])) | F.contains(bare, _bare(m["old_path"])))
    move = F.get(hits, F.lit(0))
    typed = (F.size("responses") > 0) & named
    reasons = F.filter(F.array(
        F.when(F.col("known").isNull() & (F.size("required") > 0) & (F.col("change_type") == "ADDED"), F.concat(F.lit("Required parameter(s) added: "), F.array_join("required", ", "))),
        F.when(F.col("known").isNull() & (F.size(hits) > 0), F.concat(F.lit("Path changed from "), move["old_path"], F.lit(" to "), move["new_path"])),
        F.when(typed, F.concat(F.lit("Response type changed to "), F.array_join("responses", ", "))),
        F.when(typed & F.col("called"), F.lit("Has existing consumers"))), lambda r: r.isNotNull())
    looked = F.col("present") | ~F.col("some")
    breaks = F.coalesce(looked & (F.size(reasons) > 0) & (F.col("change_type") != "BREAKING"), F.lit(False))
    return joined.select(
        "change_id", "method", "endpoint", F.when(breaks, "BREAKING").otherwise(F.col("change_type")).alias("change_type"), F.when(breaks, "CRITICAL").otherwise(F.col("severity")).alias("severity"),
        F.when(breaks, F.array_join(reasons, "; ")).otherwise(F.col("reason")).alias("reason"), "old_path", F.when(breaks, "diff").otherwise("contracts").alias("found_by"))


def diff_changes(diffs: DataFrame, consumers: DataFrame | None = None) -> DataFrame:
    """Contract changes of every diff: both sides compared, then what the lines themselves show."""
    sides = diff_sides(diffs)
    before = contracts_of_side(sides, "before")
    return escalate(diff_contracts(before, contracts_of_side(sides, "after")), diffs, before, consumers)
