"""Hard negatives beside all scores, on rows with ties, repeats, nulls, two lengths and a crowded vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rippleset.llm import rtree_negatives
from rippleset.llm.voronoi_topk import scaled

SCHEMA = "vec_id long, label int, vector array<long>, no long, win int, block int, id long, score long"


def expected(rows, k_pos=5, k_neg=10):
    """All scores of every anchor, sorted."""
    good = [(i, lab, v) for i, lab, v in rows if i is not None and lab is not None and v]
    out, seen = [], set()
    for i, lab, v in good:
        if i % 10 or (i, lab, tuple(v)) in seen:
            continue
        seen.add((i, lab, tuple(v)))
        rest = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in good if j != i and len(w) == len(v)]
        for p, j, _ in sorted(x for x in rest if x[2] == lab)[:k_pos]:
            inside = sorted(x[:2] for x in rest if x[2] != lab and 30 * -p <= 100 * -x[0] <= 90 * -p)
            out += [(i, j, rank, n, -p, -s) for rank, (s, n) in enumerate(inside[:k_neg], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 40, (6, 8))
    out = [(n, int(rng.integers(0, 3)), [int(x) for x in centres[n % 6] + rng.normal(0, 15, 8)]) for n in range(400)]
    out += [(500 + n, n % 2, [20] * 8) for n in range(150)] + [(700 + n, n % 3, [n, 5, -n]) for n in range(40)]
    out += [out[10], out[10], (10, 2, [3] * 8), (11, 1, [3] * 8), (None, 1, [1] * 8), (901, None, [1] * 8), (902, 1, None), (903, 1, []), (910, 7, [9] * 8), (920, 1, [0] * 8)]
    return out


@pytest.mark.parametrize(("block", "group"), [(2048, 2048), (64, 7)])
def test_hard_negatives(spark, rows, block, group, monkeypatch):
    monkeypatch.setattr(rtree_negatives.search, "__defaults__", (group,))
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, 1) for r in rows], SCHEMA)
    got = rtree_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == expected(rows)


def test_empty(spark):
    assert rtree_negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).collect() == []


def test_components(spark):
    got = spark.createDataFrame([([0.5, -0.5],), ([float("nan"), 1.0],), ([None, 1.0],), ([float("inf"), 1.0],), (None,)], "v array<float>").select(scaled(F.col("v"), 256).alias("v")).collect()
    assert [r["v"] for r in got] == [[128, -128], None, None, None, None]


def test_boxes_drop_leaves():
    """On grouped vectors the queue reads few leaves, and finds the same rows as all scores."""
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 100, (32, 16))
    v = (centres[np.arange(2048) % 32] + rng.normal(0, 5, (2048, 16))).astype(np.int64)
    order = rtree_negatives.str_order(v)
    tree = rtree_negatives.Tree(order, np.zeros(2048, np.int64), v[order].astype(np.float64))
    share = []
    for own in range(0, 2048, 97):
        q = v[own].astype(np.float64)
        found, read = tree.search(q, own, np.ones(2048, bool), np.array([rtree_negatives.LOWEST]), np.array([rtree_negatives.HIGHEST]), np.array([rtree_negatives.LOWEST]), 5)
        scores = v @ v[own]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != own)[:5]
        assert sorted((-s, i) for _, s, i in found) == best
        share.append(read / 64)
    assert np.mean(share) < 0.5
