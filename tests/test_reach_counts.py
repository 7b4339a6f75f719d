"""Counts of reachable nodes beside the pairs they stand for."""

import random
import time

import pytest
from pyspark.sql import functions as F

from rippleset.operators import graph
from rippleset.plans import views as v


@pytest.mark.parametrize(("kind", "depth", "marks"), [("bigint", 3, graph.MARKS), ("bigint", 3, 50), ("string", 2, 1)])
def test_counts(spark, monkeypatch, kind, depth, marks):
    """Ends that are null, loops, repeated edges, a far id in a range of its own, and searches cut at any number of marks."""
    rng = random.Random(5)
    rows = [(rng.randrange(60) * 7, rng.randrange(60) * 7) for _ in range(150)] + [(None, 3), (3, None), (10**9, 0), (10**9, 10**9), (10**9, 0)]
    text = lambda x: x if x is None or kind == "bigint" else f"n{x}"
    edges = spark.createDataFrame([(text(a), text(b)) for a, b in rows], f"src {kind}, dst {kind}")
    whole = edges.where("src is not null and dst is not null")
    pairs = graph.reachable(whole, whole.select(F.col("src").alias("node")).distinct(), depth)
    want = sorted(map(tuple, pairs.groupBy("start", "distance").count().collect()))
    monkeypatch.setattr(graph, "MARKS", marks)
    monkeypatch.setattr(graph, "BLOCK", 20)
    assert sorted(map(tuple, graph.reach_counts(edges, depth).select("start", "distance", "nodes").collect())) == want


def test_no_edges(spark):
    assert graph.reach_counts(spark.createDataFrame([], "src bigint, dst bigint"), 3).collect() == []


def test_pairs_do_not_travel(spark):
    """Two layers of 300 nodes, each linked with all of the next: 300 starts reach 600 nodes, and no join makes a row for each pair."""
    layers = spark.range(300).crossJoin(spark.range(300).withColumnRenamed("id", "to"))
    edges = layers.select(F.col("id").alias("src"), (F.col("to") + 300).alias("dst")).unionByName(layers.select((F.col("id") + 300).alias("src"), (F.col("to") + 600).alias("dst")))
    got = graph.reach_counts(edges, 2).groupBy("distance").agg(F.count(F.lit(1)).alias("starts"), F.min("nodes").alias("least"), F.max("nodes").alias("most")).collect()
    assert sorted(map(tuple, got)) == [(1, 600, 300, 300), (2, 300, 300, 300)]


def _pairs(edges, depth):
    found = graph.reachable(edges, edges.select(F.col("src").alias("node")).distinct(), depth)
    return sorted(map(tuple, found.groupBy("start", "distance").count().collect()))


def test_neighbours_do_not_travel(spark, monkeypatch):
    """Blocks that get as far as nearly every node have no neighbours sent to them, and what was shuffled before is off the disks."""
    rng = random.Random(7)
    edges = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(2000)], "src bigint, dst bigint")
    monkeypatch.setattr(graph, "BLOCK", 20)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = disk.getAllFiles().size()
    counts = graph.reach_counts(edges, 3)
    for _ in range(100):  # files are deleted in the background
        if (left := disk.getAllFiles().size()) <= before:
            break
        time.sleep(0.1)
    assert left <= before
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, counts.collect())) == _pairs(edges, 3)


@pytest.mark.parametrize("marks", [graph.MARKS, 40])
def test_far_ids_and_hubs(spark, monkeypatch, marks):
    """Ids over all 64 bits, a node with more neighbours than a section holds, and edges that come in two parts, some in both."""
    rng = random.Random(3)
    ids = [-(2**63), 2**63 - 1, *(rng.randrange(-(2**62), 2**62) for _ in range(60))]
    rows = [(ids[0], x) for x in ids] + [(rng.choice(ids), rng.choice(ids)) for _ in range(120)]
    whole, first, second = (spark.createDataFrame(x, "src bigint, dst bigint") for x in (rows, rows[:110], rows[70:]))
    monkeypatch.setattr(graph, "MARKS", marks)
    assert sorted(map(tuple, graph.reach_counts([first, second], 3).collect())) == _pairs(whole, 3)


def test_edges_in_parts(spark, monkeypatch):
    """Parts by orders hold the edges of the whole view, null orders and parts included."""
    lines = spark.createDataFrame([(None if k % 19 == 0 else k // 5, None if k % 23 == 0 else k * 7 % 40, k % 5 + 1) for k in range(300)], "l_orderkey bigint, l_partkey bigint, l_linenumber int")
    monkeypatch.setattr(v, "_tables", lambda *_: {"lineitem": lines})
    monkeypatch.setattr(v, "ROWS_PER_PART", 50)
    parts = v.parts(spark, "", v.EDGES, "lineitem")
    want = {tuple(r) for r in v.view(spark, "", v.EDGES).collect()}
    got = [{tuple(r) for r in p.collect()} for p in parts]
    assert len(parts) == 6 and all(got) and set().union(*got) == want
