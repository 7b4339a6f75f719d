"""Queries of dependency matrices, source references and paths. Their SQL says what the tables that the texts were made of must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleset.operators import graph, matrix
from rippleset.plans import views as v

#: A matrix for each part; one cell points nowhere, one at itself.
MATRICES = """
SELECT 'part' || p_partkey AS repo, '{{"schemaVersion": 1, "variables": ["src/app/A' || p_partkey || '.java", "src/app/B' || p_partkey || '.java", "lib/c' || p_partkey || '.py"], "cells": [{{"src": 0, "dest": 1, "values": {{"Call": 2.0, "Import": '
  || p_size || '.0}}}}, {{"src": 1, "dest": 1, "values": {{"Use": 1.0}}}}, {{"src": 0, "dest": 3, "values": {{"Call": 1.0}}}}, {{"src": -1, "dest": 0, "values": {{"Call": 1.0}}}}, {{"src": 2, "dest": 0, "values": {{"Contain": 1.0, "Create": 1.0}}}}]}}' AS value FROM {part}
"""
#: The files of the matrices; the third has no file.
MATRIX_FILES = """
SELECT 'part' || p_partkey AS repo, 'src/app/A' || p_partkey || '.java' AS path, 'package app;' || chr(10) || 'import app.B' || p_partkey || ';' || chr(10) || '// B' || p_partkey || '.run();' || chr(10) || 'class A {{' || chr(10)
  || '  void go() {{ B' || p_partkey || '.run(); }}' || chr(10) || '}}' AS content FROM {part}
UNION ALL SELECT 'part' || p_partkey, 'src/app/B' || p_partkey || '.java', 'class B' || p_partkey || ' {{ }}' FROM {part}
"""


def _dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.dependencies(v.view(spark, sf_dir, MATRICES, "part"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matrix.dependency_references(_dependencies(spark, sf_dir), v.view(spark, sf_dir, MATRIX_FILES, "part"))
    return found.withColumns({"lines": F.array_join(F.transform("lines", lambda n: n.cast("string")), ","), "context": F.array_join("context", " | ")})


def _paths(back: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        starts = v.view(spark, sf_dir, "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS node FROM {nation}")
        found = graph.paths(v.view(spark, sf_dir, v.EDGES), starts, 2, back)
        return found.withColumns({"rel_types": F.array_join("rel_types", ">"), "nodes": F.array_join(F.transform("nodes", lambda n: n.cast("string")), ">")})

    return query


#: New edges beside the known ones: each turned round, each once more, and one to a node that nobody knows.
NEW_EDGES = "SELECT dst AS src, 'REFER' AS rel_type, src AS dst FROM edges UNION ALL SELECT src, rel_type, dst FROM edges UNION ALL SELECT src, 'CALL', dst + 1000000000 FROM edges"


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = v.view(spark, sf_dir, v.EDGES)
    new = spark.sql(NEW_EDGES.replace("edges", "{edges}"), edges=edges)
    return graph.upsert_edges(edges, new, v.view(spark, sf_dir, "SELECT p_partkey AS node FROM {part}"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "matrix_dependencies": _dependencies,
    "matrix_statistics": lambda s, d: matrix.matrix_statistics(v.view(s, d, MATRICES, "part"), _dependencies(s, d)),
    "dependency_references": _references,
    "paths_forward": _paths(False),
    "paths_reverse": _paths(True),
    "upsert_new_edges": _upserted,
    "nearest_paths": lambda s, d: graph.nearest_paths(_paths(False)(s, d), 10),
}

_RELATIONS = """
SELECT 'part' || p_partkey AS repo, replace(source_path, '#', p_partkey::VARCHAR) AS source_path, replace(target_path, '#', p_partkey::VARCHAR) AS target_path, split_part(replace(source_path, '#', p_partkey::VARCHAR), '/', -1) AS source,
  split_part(replace(target_path, '#', p_partkey::VARCHAR), '/', -1) AS target, rel_type, CASE WHEN n = 0 THEN p_size ELSE n END::DOUBLE AS n, rel_type <> 'CONTAIN' AS direct
FROM part, (VALUES ('src/app/A#.java', 'src/app/B#.java', 'CALL', 2), ('src/app/A#.java', 'src/app/B#.java', 'IMPORT', 0), ('src/app/B#.java', 'src/app/B#.java', 'USE', 1), ('lib/c#.py', 'src/app/A#.java', 'CONTAIN', 1), ('lib/c#.py', 'src/app/A#.java', 'CREATE', 1)) AS f(source_path, target_path, rel_type, n)
"""
_E = v.sql(v.EDGES)


def _paths_sql(near: str, far: str) -> str:
    return f"""
      WITH RECURSIVE e AS (SELECT DISTINCT src, rel_type, dst, src || ' ' || rel_type || ' ' || dst AS id FROM ({_E})), p AS (
        SELECT n_nationkey::BIGINT AS start, n_nationkey::BIGINT AS node, 0 AS distance, []::VARCHAR[] AS used, []::VARCHAR[] AS types, [n_nationkey::VARCHAR] AS nodes FROM nation
        UNION ALL SELECT start, e.{far}, distance + 1, list_append(used, id), list_append(types, rel_type), list_append(nodes, e.{far}::VARCHAR) FROM p JOIN e ON p.node = e.{near} WHERE distance < 2 AND NOT list_contains(used, id))
      SELECT start, node, distance, array_to_string(types, '>') AS rel_types, array_to_string(nodes, '>') AS nodes FROM p WHERE distance > 0 AND start <> node"""


ORACLES: dict[str, str] = {
    "matrix_dependencies": _RELATIONS,
    "matrix_statistics": "SELECT 'part' || p_partkey AS repo, 3::BIGINT AS modules, 4::BIGINT AS direct, 1::BIGINT AS indirect FROM part",
    "dependency_references": """
      SELECT 'part' || p_partkey AS repo, replace(source_path, '#', p_partkey::VARCHAR) AS source_path, replace(target, '#', p_partkey::VARCHAR) AS target, rel_type, lines, replace(replace(context, '#', p_partkey::VARCHAR), '~', chr(10)) AS context
      FROM part, (VALUES ('src/app/A#.java', 'B#.java', 'CALL', '5', '// B#.run();~class A {~  void go() { B#.run(); }~}'), ('src/app/A#.java', 'B#.java', 'IMPORT', '2', 'package app;~import app.B#;~// B#.run();~class A {'), ('src/app/B#.java', 'B#.java', 'USE', '1', 'class B# { }'),
        ('lib/c#.py', 'A#.java', 'CONTAIN', '', ''), ('lib/c#.py', 'A#.java', 'CREATE', '', '')) AS f(source_path, target, rel_type, lines, context)""",
    "paths_forward": _paths_sql("src", "dst"),
    "paths_reverse": _paths_sql("dst", "src"),
    "upsert_new_edges": f"WITH edges AS ({_E}) SELECT DISTINCT * FROM ({NEW_EDGES}) WHERE src IN (SELECT p_partkey FROM part) AND dst IN (SELECT p_partkey FROM part)",
    "nearest_paths": f"SELECT *, row_number() OVER (PARTITION BY start ORDER BY distance, nodes, rel_types)::INT AS rank FROM ({_paths_sql('src', 'dst')}) QUALIFY rank <= 10",
}
