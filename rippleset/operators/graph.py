"""Dependency graph: classes of edges, counts, reachable nodes by frontier joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from rippleset.config import DIRECT_TYPES
from rippleset.streaming.storage import shared_folder

#: Starts of a block at most, and cells of a start and a node (or edges followed) that a task holds at a time.
BLOCK, MARKS = 4096, 4_000_000


def dependency_counts(edges: DataFrame) -> DataFrame:
    """Direct and indirect dependencies of each node, out and in; one aggregate over both directions."""
    direct = F.col("rel_type").isin(*DIRECT_TYPES)
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), direct.alias("direct"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("node"), direct.alias("direct"), F.lit(False).alias("out")))).alias("e")).select("e.*")
    count = lambda test: F.sum(F.expr(test).cast("long"))
    return ends.groupBy("node").agg(count("direct and out").alias("direct"), count("not direct and out").alias("indirect"), count("direct and not out").alias("reverse_direct"), count("not direct and not out").alias("reverse_indirect"))


def reachable(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """``start, node, distance`` within ``depth`` steps, smallest distance; one join for each step, duplicates dropped at once."""
    step = edges.select("src", "dst").distinct()
    front = starts.select(F.col("node").alias("start"), F.col("node"))
    reached = front.withColumn("distance", F.lit(0))
    for distance in range(1, depth + 1):
        front = front.join(step, front["node"] == step["src"]).select("start", F.col("dst").alias("node")).distinct().join(reached, ["start", "node"], "left_anti")
        reached = reached.unionByName(front.withColumn("distance", F.lit(distance)))
    return reached.where("distance > 0")


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what is run meanwhile are deleted when it ends, and don't lie on the disks beside those of the next run."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _numbered(pairs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame | None, int]:
    """``pairs`` with numbers for their nodes that leave room for a block's starts in 64 bits; the numbers' names, or the number that stands for 0."""
    spark, low = pairs.sparkSession, 0
    if all(isinstance(f.dataType, IntegralType) for f in pairs.schema):
        low, high = pairs.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
        if low is None or (high - low).bit_length() + BLOCK.bit_length() < 63:
            low = low or 0
            return pairs.select(*((F.col(c).cast("long") - F.lit(low)).alias(c) for c in ("src", "dst"))), None, low
    nodes = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct().repartitionByRange("node").sortWithinPartitions("node")
    nodes.select("node", F.monotonically_increasing_id().alias("id")).write.parquet(f"{folder}/names")
    names = spark.read.parquet(f"{folder}/names")
    for c in ("src", "dst"):
        pairs = pairs.join(names.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id")), c)
    return pairs.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")), names, 0


def _packed(a: np.ndarray) -> tuple[int, bytes]:
    """The least of some numbers, and how much more the others are, in as few bytes each as the largest needs."""
    low = a.min()
    return int(low), (a - low).astype(np.min_scalar_type(a.max() - low)).tobytes()


def _unpacked(low: int, packed: memoryview, n: int) -> tuple[int, np.ndarray]:
    return low, np.frombuffer(packed, f"u{len(packed) // n}")


#: Neighbours of consecutive nodes: the first node may go on from the section before (``carried``).
SECTION = "low bigint, high bigint, starts bigint, carried boolean, nodes binary, first binary, dst_low bigint, dsts binary"


def _cut(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sections of ``most`` edges out of edges that come in order; those that come again are dropped."""

    def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, before = [np.zeros((2, 0), np.int64)], None, None
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None:
                edges = np.stack([batch["src"].to_numpy(), batch["dst"].to_numpy()])
                other = np.append(last is None or (edges[:, 0] != last).any(), (edges[:, 1:] != edges[:, :-1]).any(axis=0))
                last = edges[:, -1]
                held.append(edges[:, other])
            n = sum(x.shape[1] for x in held)
            if n < most and batch is not None:
                continue
            edges = np.concatenate(held, axis=1)
            full = n - n % most if batch is not None else n
            for at in range(0, full, most):
                src, dst = edges[:, at : min(at + most, full)]
                first = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
                nodes, carried = src[first], bool(src[0] == before)
                before = src[-1]
                low, packed = _packed(nodes)
                dst_low, dsts = _packed(dst)
                yield pa.RecordBatch.from_pylist([{"low": low, "high": int(before), "starts": len(nodes) - carried, "carried": carried, "nodes": packed, "first": np.append(first, len(src)).astype(np.uint32).tobytes(), "dst_low": dst_low, "dsts": dsts}], pa_section)
            held = [edges[:, full:]]

    pa_section = pa.schema([(c, {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[kind]) for c, kind in (x.split() for x in SECTION.split(", "))])
    return sections


def _opened(paths: list[str], most: int = 8) -> Callable[[int], tuple[int, np.ndarray, np.ndarray, int, np.ndarray]]:
    """Reads a section from shared storage: lowest node, nodes above it, firsts of their neighbours, lowest neighbour, neighbours above it. Keeps the last few."""
    kept = {}

    def section(k: int) -> tuple[int, np.ndarray, np.ndarray, int, np.ndarray]:
        if k in kept:
            kept[k] = kept.pop(k)
            return kept[k]
        system, path = fs.FileSystem.from_uri(paths[k])
        table = pq.read_table(path, filesystem=system)
        row = {name: table[name][0] for name in table.column_names}
        first = np.frombuffer(row["first"].as_buffer(), np.uint32).astype(np.int64)
        kept[k] = *_unpacked(row["low"].as_py(), row["nodes"].as_buffer(), len(first) - 1), first, *_unpacked(row["dst_low"].as_py(), row["dsts"].as_buffer(), first[-1])
        if len(kept) > most:
            del kept[next(iter(kept))]
        return kept[k]

    return section


def _once(cells: list[np.ndarray]) -> np.ndarray:
    every = np.concatenate(cells)
    every.sort()
    return every[np.append(True, every[1:] != every[:-1])] if len(every) else every


def _counted(paths: list[str], lows: np.ndarray, highs: np.ndarray, blocks: list[tuple[int, int, int]], bits: int, low: int, depth: int, marks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of blocks of starts: breadth-first search from some of them at a time, the neighbours of all nodes of a step read section by section.

    A cell is a start's place and a node in one number. Starts whose cells are more than ``marks`` are searched in smaller groups; one start's
    cells are held whole.
    """

    def followed(section: Callable, front: np.ndarray) -> Iterator[np.ndarray]:
        """Ends of the edges out of the cells of a step, at most ``marks`` at a time."""
        front = front[np.argsort(front & ((1 << bits) - 1), kind="stable")]
        at = front & ((1 << bits) - 1)
        begin, end = np.searchsorted(at, lows), np.searchsorted(at, highs, side="right")
        for k in np.flatnonzero(begin < end):
            lowest, nodes, first, dst_low, dsts = section(int(k))
            here, wanted = front[begin[k] : end[k]], (at[begin[k] : end[k]] - lowest).astype(nodes.dtype)
            place = np.searchsorted(nodes, wanted)  # none is above the last
            known = nodes[place] == wanted
            here, place = here[known] >> bits << bits, place[known]
            degree = first[place + 1] - first[place]
            ends = np.cumsum(degree)
            for a, b in pairwise(np.unique([0, len(here), *np.searchsorted(ends, np.arange(marks, ends[-1] if len(ends) else 0, marks), side="right")])):
                d = degree[a:b]
                follow = np.arange(d.sum()) + np.repeat(first[place[a:b]] - (np.cumsum(d) - d), d)
                yield np.repeat(here[a:b] + dst_low, d) + dsts[follow].astype(np.int64)

    def counted(section: Callable, starts: np.ndarray) -> tuple[np.ndarray, int] | None:
        """New nodes of each start and step, and all cells; none if they are too many for a group."""
        rows = np.arange(len(starts) + 1) << bits
        seen = front = rows[:-1] + starts
        counts = np.zeros((len(starts), depth), np.int64)
        for distance in range(depth):
            every, raw = seen, []
            for cells in followed(section, front):
                raw.append(cells)
                if sum(map(len, raw)) >= marks:
                    every, raw = _once([every, *raw]), []
                    if len(every) > marks and len(starts) > 1:
                        return None
            every = _once([every, *raw])
            counts[:, distance] = np.diff(np.searchsorted(every, rows)) - np.diff(np.searchsorted(seen, rows))
            if distance + 1 < depth:
                front = np.setdiff1d(every, seen, assume_unique=True)
            seen = every
        return counts, len(seen)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        section, some = _opened(paths), 64
        for batch in batches:
            for k, a, b in (blocks[i] for i in batch["id"].to_pylist()):
                lowest, nodes, *_ = section(k)
                starts = lowest + nodes[a:b].astype(np.int64)
                while len(starts):
                    group = starts[:some]
                    if (done := counted(section, group)) is None:
                        some = max(1, len(group) // 2)
                        continue
                    starts, found = starts[len(group) :], done[0].ravel()
                    some = max(1, len(group) * marks // (2 * done[1]))
                    out, steps = np.repeat(group + low, depth), np.tile(np.arange(1, depth + 1, dtype=np.int32), len(group))
                    yield pa.RecordBatch.from_arrays([pa.array(out[found > 0]), pa.array(steps[found > 0]), pa.array(found[found > 0])], ["start", "distance", "nodes"])

    return search


def reach_counts(edges: DataFrame | list[DataFrame], depth: int = 2) -> DataFrame:
    """``start, distance, nodes``: of every node with an edge out, how many nodes lie at each smallest distance within ``depth`` steps.

    The same as counting ``reachable`` from all nodes, without its pairs, whose number grows with the degree to the power of the depth. The
    neighbours of all nodes are written once to shared storage, in sections of nodes in order; tasks search from blocks of starts and read the
    sections they come to. No neighbours are shuffled to the blocks, so the disks hold what the edges ask for, however far a block gets. Edges
    without both ends are none. They may come in parts, which are run one after the other; an edge may be in several.
    """
    parts = [edges] if isinstance(edges, DataFrame) else edges
    spark, section = parts[0].sparkSession, max(1, MARKS // 4)
    folder, kind = shared_folder(spark, "neighbours"), parts[0].schema["src"].dataType.simpleString()
    with _shuffles_dropped(spark):
        for part in parts:
            part.where("src is not null and dst is not null").select("src", "dst").write.mode("append").parquet(f"{folder}/pairs")
        pairs = spark.read.schema(parts[0].select("src", "dst").schema).parquet(f"{folder}/pairs")
        tasks = max(1, -(-pairs.count() // section))
        pairs, names, low = _numbered(pairs, folder)
        placed = pairs.repartitionByRange(tasks, "src").sortWithinPartitions("src", "dst").mapInArrow(_cut(section), SECTION)
        placed.write.options(**{"maxRecordsPerFile": 1, "compression": "none", "parquet.enable.dictionary": "false"}).parquet(f"{folder}/sections")
        known = spark.read.schema(SECTION).parquet(f"{folder}/sections").select("low", "high", "starts", "carried", "_metadata.file_path").orderBy("low", "high").collect()
    cores = spark.sparkContext.defaultParallelism
    size = min(BLOCK, max(64, -(-sum(r["starts"] for r in known) // (4 * cores))))
    blocks = [(k, a + r["carried"], min(a + size, r["starts"]) + r["carried"]) for k, r in enumerate(known) for a in range(0, r["starts"], size)]
    lows, highs = (np.array([r[c] for r in known], np.int64) for c in ("low", "high"))
    found = spark.range(0, len(blocks), 1, max(1, min(len(blocks), max(4 * cores, len(blocks) // 8)))).mapInArrow(_counted([r["file_path"] for r in known], lows, highs, blocks, 63 - BLOCK.bit_length(), low, depth, MARKS), "start bigint, distance int, nodes bigint")
    if names is None:
        return found.withColumn("start", F.col("start").cast(kind))
    return found.join(names, found["start"] == names["id"]).select(F.col("node").cast(kind).alias("start"), "distance", "nodes")


def node_risk(found: DataFrame, direction: str) -> DataFrame:
    """Risk of reached nodes by distance: a nearest dependent is at high risk, a nearest dependency at medium."""
    first = "high" if direction == "reverse" else "medium"
    return found.withColumn("risk", F.when(F.col("distance") == 1, first).when(F.col("distance") == 2, "medium").otherwise("low"))


def upsert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges once each by (src, rel_type, dst), without those that lack an end among ``nodes``."""
    known = nodes.select("node").distinct()
    every = edges.select("src", "rel_type", "dst").unionByName(new.select("src", "rel_type", "dst")).distinct()
    return every.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "rel_type", "dst")


def table_neighbours(foreign_keys: DataFrame) -> DataFrame:
    """Tables one reference away from each table, out and in."""
    ends = F.array(F.struct(F.col("source_table").alias("table_name"), F.col("target_table").alias("neighbour"), F.lit("out").alias("direction")), F.struct(F.col("target_table").alias("table_name"), F.col("source_table").alias("neighbour"), F.lit("in").alias("direction")))
    return foreign_keys.select(F.inline(ends)).distinct()


def paths(edges: DataFrame, starts: DataFrame, depth: int = 3, back: bool = False) -> DataFrame:
    """``start, node, distance, rel_types, nodes`` of every path of 1 to ``depth`` edges from the given starts that ends elsewhere.

    A path uses an edge once at most; edges are told apart by both ends and type. ``back`` follows them against their direction. The number of
    paths grows with the degree to the power of the depth; ``reachable`` gives the nodes alone.
    """
    step = edges.select("src", "rel_type", "dst").distinct().withColumn("edge", F.struct("src", "rel_type", "dst"))
    near, far = ("dst", "src") if back else ("src", "dst")
    front = starts.select(F.col("node").alias("start"), F.col("node"), F.array(F.col("node")).alias("nodes")).distinct()
    front = front.withColumn("used", F.expr(f"cast(array() as array<{step.schema['edge'].dataType.simpleString()}>)"))
    out = None
    for distance in range(1, depth + 1):
        met = front.join(step, front["node"] == step[near]).where(~F.array_contains("used", F.col("edge")))
        front = met.select("start", F.col(far).alias("node"), F.concat("nodes", F.array(F.col(far))).alias("nodes"), F.concat("used", F.array("edge")).alias("used"))
        found = front.where("start <> node").select("start", "node", F.lit(distance).alias("distance"), F.transform("used", lambda e: e["rel_type"]).alias("rel_types"), "nodes")
        out = found if out is None else out.unionByName(found)
    return out


def nearest_paths(found: DataFrame, most: int = 100) -> DataFrame:
    """The ``most`` nearest paths of each start, ties by their nodes and types."""
    order = Window.partitionBy("start").orderBy("distance", "nodes", "rel_types")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
