"""Dependency matrices, source references and paths on literal rows."""

import json

from rippleset.operators import graph, matrix

VALUE = {"variables": ["a/Pay.java", "b/Log.java", "c/main.py", "Base.java"], "cells": [
    {"src": 0, "dest": 1, "values": {"Import": 1, "Call": 2, "Create": 1, "Use": 1, "Extend": 1}}, {"src": 0, "dest": 9, "values": {"Call": 1}}, {"src": -1, "dest": 0, "values": {"Call": 1}},
    {"src": 2, "dest": 0, "values": {"Import": 1, "Create": 1}}, {"src": 0, "dest": 3, "values": {"Contain": 1}}, {"src": 1, "dest": 1, "values": {"Use": 1}}, {"src": 1, "dest": None, "values": {"Use": 1}}]}
JAVA = "package x;\nimport b.Log;\n// Log.skip()\nclass Pay extends Base {\n  Log log = new Log();\n  void f() { Log.a(); }\n  int n;\n  void g() { Log.b(); Log.c(); }\n  Log x1; \n  Log x2;\n  Log x3;\n}"
PYTHON = "from a.Pay import Pay\n# Pay()\nx = Pay()\ndef Pay():\n"


def test_matrix(spark):
    df = spark.createDataFrame([("r", json.dumps(VALUE)), ("r", "{broken"), ("s", json.dumps({"variables": []})), ("t", None)], "repo string, value string")
    found = matrix.dependencies(df)
    got = sorted((r["source"], r["target"], r["rel_type"], r["n"], r["direct"]) for r in found.collect())
    assert got == [
        ("Log.java", "Log.java", "USE", 1.0, True), ("Pay.java", "Base.java", "CONTAIN", 1.0, False), ("Pay.java", "Log.java", "CALL", 2.0, True), ("Pay.java", "Log.java", "CREATE", 1.0, True), ("Pay.java", "Log.java", "EXTEND", 1.0, True),
        ("Pay.java", "Log.java", "IMPORT", 1.0, True), ("Pay.java", "Log.java", "USE", 1.0, True), ("main.py", "Pay.java", "CREATE", 1.0, True), ("main.py", "Pay.java", "IMPORT", 1.0, True)]
    assert [tuple(r) for r in matrix.matrix_statistics(df, found).collect()] == [("r", 4, 8, 1)]
    files = spark.createDataFrame([("r", "a/Pay.java", JAVA), ("r", "c/main.py", PYTHON), ("r", "b/Log.java", None)], "repo string, path string, content string")
    lines = {(r["source_path"], r["target"], r["rel_type"]): (r["lines"], r["context"]) for r in matrix.dependency_references(found, files).collect()}
    assert {k: v[0] for k, v in lines.items()} == {
        ("a/Pay.java", "Log.java", "IMPORT"): [2], ("a/Pay.java", "Log.java", "CALL"): [6, 8], ("a/Pay.java", "Log.java", "CREATE"): [5], ("a/Pay.java", "Log.java", "USE"): [5, 6, 8, 9, 10], ("a/Pay.java", "Log.java", "EXTEND"): [],
        ("a/Pay.java", "Base.java", "CONTAIN"): [4], ("c/main.py", "Pay.java", "IMPORT"): [1], ("c/main.py", "Pay.java", "CREATE"): [3], ("b/Log.java", "Log.java", "USE"): []}
    assert lines["a/Pay.java", "Log.java", "IMPORT"][1] == ["package x;\nimport b.Log;\n// Log.skip()\nclass Pay extends Base {"]


def test_paths(spark):
    """A cycle, two edges between the same nodes, and a way back over another edge."""
    edges = spark.createDataFrame([("a", "CALL", "b"), ("a", "USE", "b"), ("b", "CALL", "c"), ("c", "CALL", "a"), ("c", "CALL", "c"), ("b", "CALL", "c")], "src string, rel_type string, dst string")
    starts = spark.createDataFrame([("a",), ("a",), ("z",)], "node string")
    got = sorted((r["node"], r["distance"], tuple(r["nodes"]), tuple(r["rel_types"])) for r in graph.paths(edges, starts).collect())
    assert got == [
        ("b", 1, ("a", "b"), ("CALL",)), ("b", 1, ("a", "b"), ("USE",)), ("c", 2, ("a", "b", "c"), ("CALL", "CALL")), ("c", 2, ("a", "b", "c"), ("USE", "CALL")),
        ("c", 3, ("a", "b", "c", "c"), ("CALL", "CALL", "CALL")), ("c", 3, ("a", "b", "c", "c"), ("USE", "CALL", "CALL"))]
    back = sorted((r["node"], r["distance"]) for r in graph.paths(edges, starts, 2, back=True).collect())
    assert back == [("b", 2), ("c", 1), ("c", 2)]
    assert [r["rank"] for r in graph.nearest_paths(graph.paths(edges, starts), 2).collect()] == [1, 2]
