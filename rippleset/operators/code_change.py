"""Scores of code changes, parts of file paths, and totals over consumers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleset.config import ScoringConfig
from rippleset.operators.schema_change import D, ai_points, risk_level, steps


def base_name(path: Column) -> Column:
    """Text after the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def scan_root(path: Column) -> Column:
    """Nearest folder above a file named ``src``, else the file's own folder."""
    above = F.regexp_extract(path, r"^((?:.*/)?src)/", 1)
    return F.when(above != "", above).otherwise(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def technical_risk(deps: Column, complexity: Column, lines: Column) -> Column:
    """Points of a change's dependencies, complexity and size, at most 4."""
    of_deps = F.greatest(steps(deps, (20, "2.0"), (10, "1.5"), (5, "1.0")), D("0.5"))
    return F.least(of_deps + steps(complexity, (15, "1.5"), (10, "1.0"), (5, "0.5")) + steps(lines, (100, "0.5"), (50, "0.3")), D("4.0"))


def domain_risk(path: Column, modules: Column, data_layer: Column, tables: Column, config: ScoringConfig) -> Column:
    """Points of a change's path, critical modules, data layer and tables, at most 3."""
    named = F.when(F.lower(path).rlike("|".join(config.critical_keywords)), D("0.5")).otherwise(D("0.0"))
    layer = F.when(data_layer, D("0.5")).otherwise(D("0.0"))
    return F.least(named + steps(modules, (2, "2.0"), (1, "1.5"), (0, "1.0")) + layer + steps(tables, (5, "1.0"), (2, "0.5"), (0, "0.3")), D("3.0"))


def dependency_summary(dependencies: DataFrame, config: ScoringConfig) -> DataFrame:
    """One row a change: distinct targets, critical ones among them, and whether one belongs to the data layer."""
    critical, layer = F.lower("target").rlike("|".join(config.critical_keywords)), F.col("target").rlike("|".join(config.data_layer_words))
    once = dependencies.select("change_id", "target").distinct()
    return once.groupBy("change_id").agg(F.count(F.lit(1)).alias("n_deps"), F.sum(critical.cast("long")).alias("critical_modules"), F.max(layer).alias("data_layer"))


def code_change_risk(changes: DataFrame, dependencies: DataFrame, config: ScoringConfig | None = None) -> DataFrame:
    """Scored code changes; each meets one summary row of its dependencies."""
    config = config or ScoringConfig()
    joined = changes.join(dependency_summary(dependencies, config), "change_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    deps, modules, layer = zero("n_deps"), zero("critical_modules"), F.coalesce("data_layer", F.lit(False))
    parts = joined.select(
        "change_id", technical_risk(deps, F.col("complexity"), F.col("lines_changed")).cast("decimal(4,2)").alias("technical"),
        domain_risk(F.col("path"), modules, layer, F.col("n_tables"), config).cast("decimal(4,2)").alias("domain"), F.least(ai_points(F.col("ai_risks")), D("2.0")).cast("decimal(4,2)").alias("ai"))
    score = F.least((F.col("technical") + F.col("domain") + F.col("ai")) * D(config.code_scale), D(config.cap)).cast("decimal(6,4)")
    return parts.withColumn("score", score).withColumn("level", risk_level(F.col("score"), config))


def consumer_stats(sites: DataFrame) -> DataFrame:
    """Calls of each path and the distinct repositories they come from."""
    return sites.groupBy("path").agg(F.count(F.lit(1)).alias("consumers"), F.countDistinct(F.coalesce("repo", F.lit("unknown"))).alias("sources"))


def consumers_by_repo(sites: DataFrame) -> DataFrame:
    """Calls of each path by repository."""
    return sites.groupBy("path", F.coalesce("repo", F.lit("unknown")).alias("repo")).agg(F.count(F.lit(1)).alias("consumers"))
