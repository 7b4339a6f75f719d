"""Hard negatives by an STR-packed R-tree.

Rows are sorted into tiles: by label, then by slabs of the coordinates that vary most (cuts from a bounded sample; every row is
indexed). A tile of too many rows is dealt over parts. Each part becomes one row of an index table: its vectors in
sort-tile-recursive order, cut into leaves of ``LEAF`` rows under nodes of ``FAN`` children, every node with its minimum bounding box. A box
gives an interval for each coordinate's product with a query, and their sums bound the inner product from both sides.

A search asks for the ``k`` best rows in each of a query's score windows. It goes through a block by a best-first queue on the upper
bound and drops boxes whose interval misses all windows, or whose upper bound is strictly below the k-th score found. First each query
visits its most promising block; the k-th scores found there then drop whole blocks, by the blocks' own boxes, before
anything is sent to the rest. Positives are a search with one open window among rows of the anchor's label, negatives one with a window
for each positive among the other labels.

Sizes: the sample holds at most 16 rows a tile; there are at most ``TILES`` tiles and about as many boxes in the driver (more only if
single tiles are split, or lengths mixed). A group holds one block and at most ``ASKED`` queries.

Cases: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part. Vectors of different lengths
never meet. Rows with the anchor's id are left out; other repeated rows are a candidate each. Anchors repeated in full are
answered once; anchors of one id that differ in vector or label are each answered. Equal scores go to the smaller id. Empty tables
give no rows. Only the named columns are read, so others may have any names. Scores are exact while they fit a long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleset.llm.common import slices, table, written
from rippleset.llm.voronoi_topk import scaled

#: Rows of a leaf, children of a node, rows of a block, most tiles, queries of a group, coordinates that tiles are cut on.
LEAF, FAN, BLOCK, TILES, ASKED, TILED = 32, 8, 2048, 4096, 2048, 3
LOWEST, HIGHEST = -(2**63) + 1, 2**63 - 1
FOUND = "no bigint, win int, score bigint, id bigint"


def str_order(v: np.ndarray, leaf: int = LEAF, dims: int = 6) -> np.ndarray:
    """Order of rows that puts neighbours into one leaf: slabs by the widest coordinate, slabs of each by the next, and so on."""
    widest = np.argsort(-v.astype(np.float64).var(0), kind="stable")[:dims]

    def sort(rows: np.ndarray, left: int) -> np.ndarray:
        leaves = -(-len(rows) // leaf)
        if leaves <= 1 or not left:
            return rows
        rows = rows[np.argsort(v[rows, widest[len(widest) - left]], kind="stable")]
        slabs = int(np.ceil(leaves ** (1 / left)))
        size = -(-leaves // slabs) * leaf
        return np.concatenate([sort(rows[at : at + size], left - 1) for at in range(0, len(rows), size)])

    return sort(np.arange(len(v)), len(widest))


class Tree:
    """Boxes over rows in leaf order, level by level; level 0 are the leaves."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.ids, self.labels, self.v, self.leaf, self.fan = ids, labels, v, leaf, fan
        at = np.arange(0, len(v), leaf)
        self.low, self.high = [np.minimum.reduceat(v, at)], [np.maximum.reduceat(v, at)]
        while len(self.low[-1]) > fan:
            at = np.arange(0, len(self.low[-1]), fan)
            self.low.append(np.minimum.reduceat(self.low[-1], at))
            self.high.append(np.maximum.reduceat(self.high[-1], at))

    def search(self, q: np.ndarray, own: int, allowed: np.ndarray, lows: np.ndarray, highs: np.ndarray, floors: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
        """(window, score, id) of the best ``k`` allowed rows in each window, and the number of leaves read."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        least = np.where(lows > highs, HIGHEST, np.maximum(lows, floors))  # a window's scores below this are of no use
        kept: list[list[tuple[int, int]]] = [[] for _ in lows]
        queue: list[tuple[int, int, int]] = []
        read = 0

        def push(level: int, first: int, last: int) -> None:
            low, high = self.low[level][first:last], self.high[level][first:last]
            most, fewest = high @ up + low @ down, low @ up + high @ down
            useful = ((most[:, None] >= least) & (fewest[:, None] <= highs)).any(1)
            for i in np.flatnonzero(useful):
                heapq.heappush(queue, (-int(most[i]), level, first + int(i)))

        top = len(self.low) - 1
        push(top, 0, len(self.low[top]))
        while queue:
            bound, level, node = heapq.heappop(queue)
            if -bound < least.min():
                break
            if level:
                push(level - 1, node * self.fan, min((node + 1) * self.fan, len(self.low[level - 1])))
                continue
            read += 1
            rows = slice(node * self.leaf, (node + 1) * self.leaf)
            scores = self.v[rows] @ q
            good = np.flatnonzero(allowed[rows] & (self.ids[rows] != own) & (scores >= least.min()) & (scores <= highs.max()))
            for i in good:
                score, row_id = int(scores[i]), int(self.ids[rows][i])
                for w in np.flatnonzero((least <= score) & (score <= highs)):
                    best = kept[w]
                    item = (score, -row_id)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                    if len(best) == k:
                        least[w] = max(least[w], best[0][0])
        return [(w, score, -row_id) for w, best in enumerate(kept) for score, row_id in best], read


def _tiles(labels: np.ndarray, v: np.ndarray, tiles: int, dims: list[int]) -> list:
    """Cuts for about ``tiles`` tiles, as nested [coordinate (-1: the label), cuts, children] or an empty list for one tile."""

    def cut(rows: np.ndarray, n: int, left: list[int]) -> list:
        if n <= 1 or not left or len(rows) < 2:
            return []
        values = labels[rows] if left[0] < 0 else v[rows, left[0]]
        slabs = min(n, len(np.unique(values))) if left[0] < 0 else int(np.ceil(n ** (1 / len(left))))
        cuts = np.unique(np.quantile(values, np.arange(1, slabs) / slabs, method="inverted_cdf")) if left[0] >= 0 or slabs < len(np.unique(values)) else np.unique(values)[:-1]
        slab = np.searchsorted(cuts, values, side="left")  # up to a cut, itself included
        return [left[0], cuts, [cut(rows[slab == s], max(1, round(n * (slab == s).sum() / len(rows))), left[1:]) for s in range(len(cuts) + 1)]]

    return cut(np.arange(len(labels)), tiles, [-1, *dims])


def _route(tree: list, labels: np.ndarray, column) -> np.ndarray:
    """The tile of each row; ``column(i)`` gives coordinate i of all rows."""
    out, count = np.zeros(len(labels), np.int32), 0

    def go(node: list, rows: np.ndarray) -> None:
        nonlocal count
        if not node:
            out[rows] = count
            count += 1
            return
        dim, cuts, children = node
        slab = np.searchsorted(cuts, (labels if dim < 0 else column(dim))[rows], side="left")
        for s, child in enumerate(children):
            go(child, rows[slab == s])

    go(tree, np.arange(len(labels)))
    return out


def index(rows: DataFrame, block: int = BLOCK, most_tiles: int = TILES) -> DataFrame:
    """The packed index of ``rows`` (_id, _label, _v): a row for each block with its box, labels' range and packed rows."""
    spark = rows.sparkSession
    total = rows.count()
    tiles = min(most_tiles, -(-total // block))
    block = max(block, -(-total // most_tiles))
    every = max(1, total // (16 * max(1, tiles)))
    drawn = rows.where(F.pmod(F.xxhash64("_id", "_v"), F.lit(every)) == 0).select("_label", "_v").limit(64 * max(1, tiles)).collect() if tiles > 1 else []
    tree: list = []
    if drawn:
        width = max(len(r["_v"]) for r in drawn)
        v = np.zeros((len(drawn), width), np.float64)
        for i, r in enumerate(drawn):
            v[i, : len(r["_v"])] = r["_v"]
        tree = _tiles(np.array([r["_label"] for r in drawn]), v, tiles, [int(d) for d in np.argsort(-v.var(0), kind="stable")[:TILED]])
    shared = spark.sparkContext.broadcast(tree)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            lists = batch.column("_v")
            values, ends = np.asarray(lists.flatten()), np.cumsum(np.asarray(pc.list_value_length(lists)))
            sizes = np.diff(ends, prepend=0)

            def column(i: int) -> np.ndarray:
                out = np.zeros(len(sizes))
                has = sizes > i
                out[has] = values[(ends - sizes)[has] + i]
                return out

            tile = _route(shared.value, np.asarray(batch.column("_label")), column)
            yield pa.RecordBatch.from_arrays([pa.array(tile), *(batch.column(c) for c in ("_id", "_label", "_v"))], ["tile", "_id", "_label", "_v"])

    tiled = written(rows.select("_id", "_label", "_v").mapInArrow(route, "tile int, _id bigint, _label bigint, _v array<bigint>"), "rtree-tiles")
    parts = tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * block).collect()  # tiles at most
    many = F.coalesce(F.create_map(*[F.lit(x) for r in parts for x in (r["tile"], -(-r["n"] // block))])[F.col("tile")], F.lit(1)) if parts else F.lit(1)
    # Seeded and over a written table: a task that runs again deals its rows alike, repeated rows among them.
    dealt = tiled.withColumn("part", F.floor(F.rand(7) * many)).withColumn("dims", F.size("_v"))

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("_id", kind="stable")
        v = np.stack(batch["_v"].to_numpy()).astype(np.int64)
        order = str_order(v)
        v, labels, ids = v[order], batch["_label"].to_numpy(np.int64)[order], batch["_id"].to_numpy(np.int64)[order]
        return pd.DataFrame({"dims": [np.int32(v.shape[1])], "n": [np.int32(len(v))], "low_label": [labels.min()], "high_label": [labels.max()],
                             "low": [v.min(0).tobytes()], "high": [v.max(0).tobytes()], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "vectors": [v.tobytes()]})

    packed = dealt.groupBy("tile", "part", "dims").applyInPandas(pack, "dims int, n int, low_label bigint, high_label bigint, low binary, high binary, ids binary, labels binary, vectors binary")
    return written(written(packed, "rtree-packed").withColumn("block", F.monotonically_increasing_id()), "rtree")


def search(asked: DataFrame, packed: DataFrame, k: int, same: bool, group: int = ASKED) -> DataFrame:
    """``no, win, score, id``: the ``k`` best rows in each window of each query of ``asked`` (no, id, label, v, lows, highs).

    ``same``: only rows of the query's label, else only rows of other labels.
    """
    spark = asked.sparkSession
    boxes = packed.select("block", "dims", "low_label", "high_label", "low", "high").toPandas()  # a box for each block
    shared = spark.sparkContext.broadcast([
        (int(r.block), int(r.dims), int(r.low_label), int(r.high_label), np.frombuffer(r.low, np.int64), np.frombuffer(r.high, np.int64)) for r in boxes.itertuples()])
    slots = max(1, -(-asked.count() // group))
    columns = ["block", "slot", "no", "id", "label", "v", "lows", "highs", "floors"]
    sent = "block bigint, slot int, no bigint, id bigint, label bigint, v array<bigint>, lows array<bigint>, highs array<bigint>, floors array<bigint>"

    def send(first: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_dims: dict[int, list] = {}
            for box in shared.value:
                by_dims.setdefault(box[1], []).append(box)
            stacked = {d: tuple(np.array([b[i] for b in of], kind) for i, kind in ((0, np.int64), (2, np.int64), (3, np.int64), (4, np.float64), (5, np.float64))) for d, of in by_dims.items()}
            for batch in slices(batches):
                out = []
                for row in batch.to_pylist():
                    if len(row["v"]) not in stacked:
                        continue
                    block, low_label, high_label, low, high = stacked[len(row["v"])]
                    q = np.array(row["v"], np.float64)
                    up, down = np.maximum(q, 0), np.minimum(q, 0)
                    slack = 1e-9 * np.maximum(np.abs(low), np.abs(high)) @ np.abs(q) + 1
                    most, fewest = high @ up + low @ down + slack, low @ up + high @ down - slack
                    lows, highs = np.array(row["lows"]), np.array(row["highs"])
                    floors = np.array(row["floors"] or [LOWEST] * len(lows))
                    least = np.where(lows > highs, HIGHEST, np.maximum(lows, floors))
                    useful = ((most[:, None] >= least) & (fewest[:, None] <= highs) & (lows <= highs)).any(1)
                    useful &= (low_label <= row["label"]) & (high_label >= row["label"]) if same else (low_label != row["label"]) | (high_label != row["label"])
                    at = np.flatnonzero(useful)
                    if first:
                        at = at[[np.argmax(most[at])]] if len(at) else at
                    else:
                        at = at[block[at] != row["seen"]]
                    slot = row["no"] % slots
                    out += [(int(b), slot, row["no"], row["id"], row["label"], row["v"], row["lows"], row["highs"], floors.tolist()) for b in block[at]]
                made = dict(zip(columns, zip(*out, strict=True), strict=True)) if out else {c: [] for c in columns}
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(list(made[c]), t) for c, t in zip(columns, kinds, strict=True)], columns)

        return run

    spread = packed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))

    def solve(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        if len(queries) and len(blocks):
            b = blocks.iloc[0]
            v = np.frombuffer(b["vectors"], np.int64).reshape(b["n"], b["dims"])
            ids, labels = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["labels"], np.int64)
            q = np.stack(queries["v"].to_numpy())
            if float(np.abs(v).max()) * float(np.abs(q).max()) * v.shape[1] < 2**52:  # then doubles are exact
                v, q = v.astype(np.float64), q.astype(np.float64)
            tree, is_label = Tree(ids, labels, v), {label: labels == label for label in queries["label"].unique()}
            for no, own, label, vector, lows, highs, floors in zip(queries["no"], queries["id"], queries["label"], q, queries["lows"], queries["highs"], queries["floors"], strict=True):
                found, _ = tree.search(vector, own, is_label[label] if same else ~is_label[label], np.array(lows), np.array(highs), np.array(floors), k)
                out += [(no, w, score, row_id) for w, score, row_id in found]
        return pd.DataFrame(out, columns=["no", "win", "score", "id"]).astype({"no": "int64", "win": "int32", "score": "int64", "id": "int64"})

    def visit(queries: DataFrame, first: bool) -> tuple[DataFrame, DataFrame]:
        goes = written(queries.mapInArrow(send(first), sent), "rtree-asked")
        return goes, goes.groupBy("block", "slot").cogroup(spread.groupBy("block", "slot")).applyInPandas(solve, FOUND)

    place = Window.partitionBy("no", "win").orderBy(F.desc("score"), "id")
    unknown = asked.withColumns({"floors": F.lit(None).cast("array<bigint>"), "seen": F.lit(None).cast("bigint")})
    went, found = visit(unknown, True)
    found = written(found, "rtree-first")
    floor = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k).select("no", F.struct("win", "score").alias("x")).groupBy("no").agg(F.map_from_entries(F.collect_list("x")).alias("floor"))
    known = asked.join(went.select("no", F.col("block").alias("seen")), "no").join(floor, "no", "left")
    floors = F.transform("lows", lambda _, i: F.coalesce(F.col("floor")[i], F.lit(LOWEST)))
    _, more = visit(known.withColumn("floors", floors).select(*asked.columns, "floors", "seen"), False)
    return found.unionByName(more).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, lowest: int = 30, highest: int = 90, block: int = BLOCK) -> DataFrame:
    """Negatives of each anchor and positive: rows of other labels that score from ``lowest`` to ``highest`` hundredths of the positive's score.

    ``rows`` holds ``vec_id``, ``label`` and ``vector`` (longs).
    """
    good = rows.where("vec_id is not null and label is not null and vector is not null and size(vector) > 0")
    good = written(good.select(F.col("vec_id").cast("long").alias("_id"), F.col("label").cast("long").alias("_label"), F.col("vector").alias("_v"), F.coalesce(is_anchor, F.lit(False)).alias("_anchor")), "rtree-rows")
    packed = index(good, block)
    anchors = good.where("_anchor").groupBy(F.col("_id").alias("id"), F.col("_label").alias("label"), F.col("_v").alias("v")).agg(F.lit(0).alias("one")).drop("one")
    anchors = written(anchors.withColumn("no", F.monotonically_increasing_id()), "rtree-anchors")
    whole = anchors.withColumns({"lows": F.array(F.lit(LOWEST)), "highs": F.array(F.lit(HIGHEST))})
    near = written(search(whole, packed, positives, True).select("no", (F.col("rank") - 1).alias("win"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "rtree-positives")
    share = lambda part: F.col("positive_score").cast("decimal(20,0)") * part / 100
    low, high = F.ceil(share(lowest)).cast("long"), F.floor(share(highest)).cast("long")
    windows = near.select("no", F.struct("win", low.alias("low"), high.alias("high")).alias("x")).groupBy("no").agg(F.array_sort(F.collect_list("x")).alias("x"))
    asked = anchors.join(windows, "no").withColumns({"lows": F.col("x.low"), "highs": F.col("x.high")}).drop("x")
    far = search(written(asked, "rtree-windows"), packed, negatives, False).select("no", "win", F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = far.join(near, ["no", "win"]).join(anchors.select("no", F.col("id").alias("anchor_id")), "no")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; labels of every seventh row are moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    given = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), scaled(F.col("embedding"), 256).alias("vector"))
    return hard_negatives(given, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
