"""Dependency matrices: JSON of files and cells to typed dependencies, and the source lines that show each of them.

A matrix is one row (``repo, value``): ``variables`` are the files, a cell names two of them by place and counts its relations by type. Cells
whose places don't exist are left out, so is what is no such JSON. References are looked for on the row of the file that depends: its
dependencies are gathered first, so a file's text is read once and never copied. Comment lines and empty ones are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleset.config import DIRECT_TYPES

MATRIX = "struct<variables: array<string>, cells: array<struct<src: int, dest: int, values: map<string, double>>>>"
#: References that are shown for each dependency, and lines of context on either side.
MOST, AROUND = 5, 2


def dependencies(matrices: DataFrame) -> DataFrame:
    """``repo, source_path, target_path, source, target, rel_type, n, direct`` of every relation in every cell."""
    cells = matrices.select("repo", F.from_json("value", MATRIX).alias("m")).select("repo", F.col("m.variables").alias("files"), F.inline("m.cells"))
    path = lambda place: F.when(F.col(place) >= 0, F.get("files", F.col(place)))
    named = cells.select("repo", path("src").alias("source_path"), path("dest").alias("target_path"), F.explode("values").alias("rel_type", "n")).where("source_path is not null and target_path is not null")
    name, kind = lambda c: F.regexp_extract(c, r"([^/]*)$", 1), F.upper("rel_type")
    return named.select("repo", "source_path", "target_path", name("source_path").alias("source"), name("target_path").alias("target"), kind.alias("rel_type"), "n", kind.isin(*DIRECT_TYPES).alias("direct"))


def matrix_statistics(matrices: DataFrame, found: DataFrame) -> DataFrame:
    """``repo, modules, direct, indirect`` of every repository."""
    files = matrices.select("repo", F.explode(F.from_json("value", MATRIX)["variables"])).groupBy("repo").agg(F.count(F.lit(1)).alias("modules"))
    kinds = found.groupBy("repo").agg(F.count_if("direct").alias("direct"), F.count_if(~F.col("direct")).alias("indirect"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return files.join(kinds, "repo", "left").select("repo", "modules", zero("direct"), zero("indirect"))


def _shows(line: Column, rel: Column, target: Column, python: Column) -> Column:
    """Whether a trimmed line shows a relation to a target (its name without extension)."""
    has, begins = F.contains(line, target), lambda *words: line.rlike(rf"^(?:{'|'.join(words)})")
    called = has & F.contains(line, F.lit(".")) & F.contains(line, F.lit("("))
    declared = F.contains(line, F.lit("class ")) & has
    inherits = F.contains(line, F.concat(F.lit("extends "), target)) | F.contains(line, F.concat(F.lit("implements "), target))
    return (
        F.when(rel == "IMPORT", F.when(python, begins("import ", "from ") & has).otherwise(begins("import") & has))
        .when(rel == "CALL", called)
        .when(rel == "USE", has & F.when(python, ~begins("import", "from", "class", "def")).otherwise(~begins("import", "package")))
        .when(rel == "CREATE", has & F.when(python, F.contains(line, F.lit("(")) & ~begins("def ", "class ")).otherwise(F.contains(line, F.lit("new "))))
        .when(rel == "CONTAIN", F.when(python, F.contains(line, F.concat(F.lit("class "), target))).otherwise(declared | inherits)).otherwise(F.lit(False)))


def dependency_references(found: DataFrame, files: DataFrame, most: int = MOST, around: int = AROUND) -> DataFrame:
    """``repo, source_path, target, rel_type, lines, context`` of every dependency: the first lines that show it, and the text around each."""
    wanted = found.select("repo", F.col("source_path").alias("path"), F.struct("target", "rel_type").alias("d")).groupBy("repo", "path").agg(F.collect_set("d").alias("wanted"))
    rows = wanted.join(files.select("repo", "path", F.split("content", "\n").alias("text")), ["repo", "path"], "left").select("repo", "path", "text", F.inline("wanted"))
    python, target = F.col("path").endswith(".py"), F.regexp_replace("target", r"\.(?:py|java)$", "")
    counted = F.transform("text", lambda s, i: F.struct((i + 1).alias("line"), F.trim(s).alias("text")))
    read = F.filter(counted, lambda x: (x["text"] != "") & ~F.when(python, x["text"].startswith("#")).otherwise(x["text"].startswith("//")) & _shows(x["text"], F.col("rel_type"), target, python))
    places = F.slice(F.transform(read, lambda x: x["line"]), 1, most)
    shown = rows.withColumn("lines", F.coalesce(places, F.expr("cast(array() as array<int>)")))
    first = lambda n: F.greatest(n - around, F.lit(1))
    context = F.transform("lines", lambda n: F.trim(F.array_join(F.slice("text", first(n), n + around - first(n) + 1), "\n")))
    return shown.select("repo", F.col("path").alias("source_path"), "target", "rel_type", "lines", context.alias("context"))
