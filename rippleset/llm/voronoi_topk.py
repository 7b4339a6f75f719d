"""Exact top-k inner-product search as a Voronoi join.

Pivots cut the space into cells. Every vector goes to its nearest pivot; summaries hold each cell's size and the distances of its
k + 1 members nearest to the pivot. From them follows, for each cell of queries, a score that at least k vectors reach, whatever the query
in the cell. A data vector is sent to a group of query cells only if the bound p.x + r |x| (pivot p, cell radius r) reaches that
score for one of the cells. Groups hold at most ``QUERIES`` queries: small neighbouring cells share one, a crowded cell is split. The data
sent to a group is dealt in blocks, so that a crowded cell is no single task; blocks are solved alone and their best k merged.

Cases: vectors that are null or empty or hold null or non-finite components take no part. Vectors of different lengths never meet. Equal scores go
to the smaller id, and equal ids with equal scores (repeated rows) are one candidate each. A query is not its own candidate: rows
with its id are left out. Scores are exact while they fit a long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from rippleset.llm.common import slices, table, written

#: Pivots, queries of a group, data rows of a block.
PIVOTS, QUERIES, BLOCK = 64, 2048, 16_384


def _rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    lists = batch.column(column)
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def _groups(cells: dict[int, int]) -> dict[int, list[int]]:
    """Groups of query cells, in cell order: {cell: its groups}, several for a crowded cell."""
    out, group, room = {}, -1, 0
    for cell, n in sorted(cells.items()):
        if n > QUERIES:
            parts = -(-n // QUERIES)
            out[cell] = list(range(group + 1, group + 1 + parts))
            group, room = group + parts, 0
            continue
        if n > room:
            group, room = group + 1, QUERIES
        out[cell] = [group]
        room -= n
    return out


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "vector", pivots: int = PIVOTS) -> DataFrame:
    """``query_id``, ``rank``, ``id_col``, ``score`` of each query's ``k`` best rows of ``df`` (vectors of longs)."""
    good = df.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q")).where("_id is not null")
    good = written(good, "vectors")
    sizes = [r[0] for r in good.select(F.size("_v").alias("n")).distinct().orderBy("n").collect()]
    parts = [_one_length(good.where(F.size("_v") == n), n, k, pivots) for n in sizes]
    out = parts[0] if parts else good.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("vec_id", id_col)


def _one_length(good: DataFrame, dims: int, k: int, pivots: int) -> DataFrame:
    spark = good.sparkSession
    drawn = good.select("_v").distinct().orderBy(F.xxhash64("_v"), "_v").limit(pivots).collect()  # pivots x dims numbers
    p = np.array([r[0] for r in drawn], np.float64)

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            v = _rows(batch, "_v").astype(np.float64)
            square = np.maximum((v**2).sum(1)[:, None] - 2 * v @ p.T + (p**2).sum(1), 0)
            cell = square.argmin(1)
            distance = np.sqrt(((v - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_v"), batch.column("_q"), pa.array(cell.astype(np.int32)), pa.array(distance)], ["_id", "_v", "_q", "cell", "distance"])

    celled = written(good.mapInArrow(nearest, "_id bigint, _v array<bigint>, _q boolean, cell int, distance double"), "vectors-by-cell")

    # Summaries: query cells' sizes and radii; data cells' k + 1 smallest distances, first for each part of a cell.
    queries = {r["cell"]: (r["n"], r["radius"]) for r in celled.where("_q").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()}
    if not queries:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")

    def least(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = pd.DataFrame({"cell": pd.Series(dtype="int32"), "distance": pd.Series(dtype="float64")})
        for batch in batches:
            kept = pd.concat([kept, batch.to_pandas()]).sort_values("distance").groupby("cell").head(k + 1)
        yield pa.RecordBatch.from_pandas(kept.astype({"cell": "int32"}), preserve_index=False)

    order = Window.partitionBy("cell").orderBy("distance")
    near = celled.select("cell", "distance").mapInArrow(least, "cell int, distance double").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    near = near.select("cell", "distance").toPandas()  # pivots x (k + 1) numbers

    norm, between = np.sqrt((p**2).sum(1)), p @ p.T
    groups = _groups({cell: n for cell, (n, _) in queries.items()})
    cells = sorted(queries)
    reach = np.full(len(cells), -np.inf)  # a score that k vectors reach for every query of the cell
    for row, i in enumerate(cells):
        r, j, d = queries[i][1], near["cell"].to_numpy(), near["distance"].to_numpy()
        low = between[i, j] - norm[i] * d - r * norm[j] - r * d
        if len(low) > k:  # one of them may be the query itself
            reach[row] = np.sort(low)[-(k + 1)]
    slack = 1e-9
    radius = np.array([queries[i][1] for i in cells])
    plan = spark.sparkContext.broadcast((p[cells], radius, reach, [groups[i] for i in cells]))
    blocks = max(1, -(-celled.count() // BLOCK))
    n_groups = 1 + max(g for of in groups.values() for g in of)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, r, floor, targets = plan.value
        for batch in slices(batches, 4096):
            v = _rows(batch, "_v").astype(np.float64)
            size = np.sqrt((v**2).sum(1))[:, None]
            high = v @ pivot.T + r * size
            high += slack * (np.abs(high) + r * size + 1) + 1
            wanted = np.zeros((len(v), n_groups), bool)
            for c, of in enumerate(targets):
                wanted[:, of] |= (high[:, c] >= floor[c])[:, None]
            row, group = np.nonzero(wanted)
            ids = np.asarray(batch.column("_id"))
            block = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(block[row].astype(np.int32)), pa.array(ids[row]), batch.column("_v").take(pa.array(row))], ["grp", "block", "_id", "_v"])

    data = celled.select("_id", "_v").mapInArrow(send, "grp int, block int, _id bigint, _v array<bigint>")
    of = F.create_map(*[F.lit(x) for i in cells for x in (i, groups[i][0])])[F.col("cell")]
    many = F.create_map(*[F.lit(x) for i in cells for x in (i, len(groups[i]))])[F.col("cell")]
    asked = celled.where("_q").select((of + F.pmod(F.xxhash64("_id"), many).cast("int")).alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "_id", "_v")

    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if not len(queries) or not len(data):
            return none
        data = data.sort_values("_id", kind="stable")
        ids, v = data["_id"].to_numpy(), np.stack(data["_v"].to_numpy())
        q = np.stack(queries["_v"].to_numpy())
        small = float(np.abs(v).max()) * float(np.abs(q).max()) * v.shape[1] < 2**52  # then doubles are exact
        if small:
            v, q = v.astype(np.float64), q.astype(np.float64)
        made = []
        for at in range(0, len(q), 256):
            scores = (q[at : at + 256] @ v.T).astype(np.int64)
            for query, row in zip(queries["_id"].to_numpy()[at : at + 256], scores, strict=True):
                floor = np.partition(row, max(0, len(row) - k - 1))[max(0, len(row) - k - 1)]
                while True:
                    best = np.flatnonzero((row >= floor) & (ids != query))
                    if len(best) >= min(k, int((ids != query).sum())):
                        break
                    floor = np.iinfo(np.int64).min
                best = best[np.argsort(-row[best], kind="stable")][:k]
                made.append(pd.DataFrame({"query_id": query, "vec_id": ids[best], "score": row[best]}))
        return pd.concat(made) if made else none

    solved = asked.groupBy("grp", "block").cogroup(data.groupBy("grp", "block")).applyInPandas(solve, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(vector: Column, scale: int = 1024) -> Column:
    """Components as longs, floor(scale x); null where a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def op4_voronoi_topk(spark, sf_dir: str) -> DataFrame:
    """The ten best rows for every hundredth vector."""
    given = table(spark, sf_dir, "embeddings").select("vec_id", scaled(F.col("embedding")).alias("vector"))
    return top_k(given, F.col("vec_id") % 100 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
