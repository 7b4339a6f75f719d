"""Changes between two states of API contracts: parameters by name, types, removed, added and moved endpoints, and their risk.

A contract is ``change_id, method, path, line, return_type, params`` (as ``endpoints`` finds it); all comparing is within a change. Of repeated
(method, path) the last line wins. Changes come as ``change_id, method, endpoint, change_type, severity, reason, old_path``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleset.config import ScoringConfig
from rippleset.operators.schema_change import D, risk_level

KEY = ("change_id", "method", "path")


def states(before: DataFrame, after: DataFrame) -> DataFrame:
    """``KEY, a, b, first_line``: each key's last contract on either side (null: none), and the line where it first stands."""
    side = lambda df, name: df.select(*KEY, "line", F.lit(name).alias("side"), F.struct("return_type", "params").alias("of"))
    last = lambda name: F.max_by("of", F.when(F.col("side") == name, F.col("line"))).alias(name)
    return side(before, "a").unionByName(side(after, "b")).groupBy(*KEY).agg(last("a"), last("b"), F.min("line").alias("first_line"))


def parameter_changes(before: Column, after: Column) -> Column:
    """``text, breaking`` of each difference of two parameter lists: removed, added, another type."""
    lacks = lambda those, p: ~F.exists(those, lambda q: q["name"] == p["name"])
    said = lambda text, breaking: F.struct(text.alias("text"), F.coalesce(breaking, F.lit(False)).alias("breaking"))
    gone = F.transform(F.filter(before, lambda p: lacks(after, p)), lambda p: said(F.concat(F.when(p["required"], "Required").otherwise("Optional"), F.lit(" parameter '"), p["name"], F.lit("' removed")), p["required"]))
    new = F.transform(F.filter(after, lambda p: lacks(before, p)), lambda p: said(F.concat(F.lit("New "), F.when(p["required"], "required").otherwise("optional"), F.lit(" parameter '"), p["name"], F.lit("' added")), p["required"]))
    other = lambda p: F.filter(after, lambda q: q["name"] == p["name"])[0]
    typed = F.transform(
        F.filter(before, lambda p: F.exists(after, lambda q: (q["name"] == p["name"]) & ~q["type"].eqNullSafe(p["type"]))),
        lambda p: said(F.concat(F.lit("Parameter '"), p["name"], F.lit("' type changed: "), p["type"], F.lit(" → "), other(p)["type"]), F.lit(True)))
    return F.concat(gone, new, typed)


def masked_paths(path: Column) -> Column:
    """``key, hole``: the path's segments with one of them left out, once for each place; letter case and names in braces don't count."""
    parts = F.transform(F.split(F.regexp_replace(F.lower(path), "^/+|/+$", ""), "/"), lambda s: F.regexp_replace(s, r"\{[^}]+\}", "{}"))
    masked = lambda place: F.array_join(F.transform(parts, lambda s, i: F.when(i == place, F.lit("\x00")).otherwise(s)), "/")
    return F.transform(parts, lambda s, i: F.struct(masked(i).alias("key"), s.alias("hole")))


def moved_endpoints(before: DataFrame, after: DataFrame) -> DataFrame:
    """``change_id, method, path, old_path``: endpoints of ``after`` and the first of ``before`` that differs in one segment.

    Two paths differ in one segment when they share a masked path but not the segment left out. For each masked path the two first
    endpoints with different segments are kept: one of them always differs, so no key ever holds a list of pairs.
    """
    masked = lambda df: df.select("change_id", "method", "path", "first_line", F.inline(masked_paths(F.col("path"))))
    firsts = masked(before).groupBy("change_id", "method", "key", "hole").agg(F.min(F.struct("first_line", "path")).alias("old"))
    two = firsts.withColumn("_n", F.row_number().over(Window.partitionBy("change_id", "method", "key").orderBy("old"))).where("_n <= 2").drop("_n")
    met = masked(after).alias("a").join(two.alias("b"), ["change_id", "method", "key"]).where(F.col("a.hole") != F.col("b.hole"))
    found = met.groupBy("change_id", "method", F.col("a.path").alias("path")).agg(F.min("b.old").alias("old"))
    return found.select("change_id", "method", "path", F.col("old.path").alias("old_path"))


def diff_contracts(before: DataFrame, after: DataFrame) -> DataFrame:
    """All changes from ``before`` to ``after``: moved, removed, added and modified endpoints. An endpoint is gone only if no contract has its key."""
    both = states(before, after)
    moved = moved_endpoints(both.where("b is null"), both.where("a is null"))
    ends = F.array(F.struct("path", "old_path", F.lit(False).alias("left")), F.struct(F.col("old_path").alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit(True).alias("left")))
    known = moved.select("change_id", "method", F.inline(ends)).groupBy(*KEY).agg(F.max("old_path").alias("old_path"), F.max("left").alias("left"))
    joined = both.join(known, list(KEY), "left")
    gone, new = F.col("b").isNull(), F.col("a").isNull()
    returned = F.when(F.col("a.return_type") != F.col("b.return_type"), F.array(F.struct(
        F.concat(F.lit("Return type changed: "), F.col("a.return_type"), F.lit(" → "), F.col("b.return_type")).alias("text"), F.lit(True).alias("breaking"))))
    none = F.expr("cast(array() as array<struct<text: string, breaking: boolean>>)")
    found = F.when(~gone & ~new, F.concat(parameter_changes(F.col("a.params"), F.col("b.params")), F.coalesce(returned, none))).otherwise(none)
    told = joined.withColumn("found", found).where(F.when(gone, ~F.coalesce("left", F.lit(False))).when(new, F.lit(True)).otherwise(F.size("found") > 0))
    moves = new & F.col("old_path").isNotNull()
    broken = moves | gone | F.exists("found", lambda x: x["breaking"])
    reason = (
        F.when(moves, F.concat(F.lit("Endpoint path changed from '"), F.col("old_path"), F.lit("' to '"), F.col("path"), F.lit("'"))).when(gone, "Endpoint removed")
        .when(new, "New endpoint added").otherwise(F.array_join(F.transform("found", lambda x: x["text"]), "; ")))
    return told.select(
        "change_id", "method", F.col("path").alias("endpoint"), F.when(broken, "BREAKING").when(new, "ADDED").otherwise("MODIFIED").alias("change_type"),
        F.when(broken, "CRITICAL").when(new, "LOW").otherwise("MEDIUM").alias("severity"), reason.alias("reason"), "old_path")


def api_change_risk(changes: DataFrame, consumers: DataFrame, ai_risks: DataFrame | None = None, config: ScoringConfig | None = None) -> DataFrame:
    """``change_id, n_breaking, n_consumers, raw_score, score, level``: the points of a change's breaking endpoints and of their callers.

    ``consumers`` holds ``path`` of every call, in any letter case; they are counted before the join. ``ai_risks`` holds ``change_id, n_risks``. The raw score
    has no bound and gives the level; ``score`` stops at 10.
    """
    calls = consumers.groupBy(F.lower("path").alias("endpoint")).agg(F.count(F.lit(1)).alias("n"))
    broken = changes.withColumn("endpoint", F.lower("endpoint")).join(calls, "endpoint", "left")
    is_broken = F.col("change_type") == "BREAKING"
    sums = broken.groupBy("change_id").agg(F.count_if(is_broken).alias("n_breaking"), F.sum(F.coalesce("n", F.lit(0).cast("long"))).alias("n_consumers"))
    sums = sums.join(ai_risks.select("change_id", "n_risks"), "change_id", "left") if ai_risks is not None else sums.withColumn("n_risks", F.lit(0))
    factor = F.when(F.col("n_consumers") > 10, D("1.5")).when(F.col("n_consumers") > 5, D("1.3")).when(F.col("n_consumers") > 0, D("1.1")).otherwise(D("1.0"))
    base = F.least(F.col("n_breaking") * D("3.0") * factor, D("10.0"))
    insight = F.least(F.coalesce("n_risks", F.lit(0)) * D("0.5"), D("2.0"))
    raw = ((base + insight) * F.when((F.col("n_breaking") > 0) & (F.col("n_consumers") > 0), D("1.5")).otherwise(D("1.0"))).cast("decimal(8,3)")
    scored = sums.select("change_id", "n_breaking", "n_consumers", raw.alias("raw_score"), F.least(raw, D("10.0")).cast("decimal(8,3)").alias("score"))
    return scored.withColumn("level", risk_level(F.col("raw_score"), config))


def endpoint_node_risk(change_type: Column) -> Column:
    """Risk of an endpoint's node in a graph."""
    return F.when(change_type == "BREAKING", "critical").when(change_type == "MODIFIED", "high").otherwise("low")
