"""Spelling variants: words one edit apart, found in k-d trees over letter counts.

One inserted, deleted or replaced letter changes a word's letter counts by at most two in all (L1), so near words lie close to each other.
For every length there is a k-d tree over the count vectors of its words. Its upper part is cut from a bounded sample and makes
cells; every word goes as data to the one cell that holds it, and as a query to the cells of its own length and of the next that its
range (two, or one) touches. A cell of too many words is dealt over parts. Within a part the tree goes on down to leaves of ``LEAF``
words with their boxes; a leaf of queries walks down the tree, drops boxes out of range, and for the words left the order of
letters is verified. Letters that no cut has seen still count in the boxes and in the verification.

The words: maximal runs of letters of every whole text, A-Z lower-cased; some runs lose a letter by a hash of document and run
(``with_typos``); words shorter than ``LEAST_LENGTH`` or met once take no part. Counting is Spark's; partial counts come before the shuffle, so a very
frequent word is no hot key.

Sizes: ``SAMPLE`` words and at most ``CELLS`` cells in the driver. A group holds a part of a cell (about ``CELL`` words) and the
queries that touch it, compared ``QUERIES`` at a time.

Cases: null and empty texts have no words. A null id counts as the empty text in the hash. Repeated rows count again. A very long text is one row
of the count like any other. Empty tables give no rows. Only id and text are read, so other columns may have any names. Ties for a
word's form go to the smaller word in code-point order.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleset.llm.common import table, written

#: Words of a leaf, of a cell, of the sample; most cells; queries of one tree, and data words beside a leaf of them, at a time.
LEAF, CELL, SAMPLE, CELLS, QUERIES, COMPARED = 64, 50_000, 65_536, 4096, 50_000, 65_536
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR, TYPO = 7, 2, 10, 31
#: a-z and the code points from U+00C0 to U+00FF.
FIRST, LAST = 0xC0, 0xFF
LETTERS = 26 + LAST - FIRST + 1


def with_typos(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo: int = TYPO, least: int = LEAST_LENGTH) -> DataFrame:
    """``word`` of every run that is long enough, with the letter taken out where the hash says so."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), upper, lower), F.lit(f"([a-z\\u00C0-\\u00FF]{{{least},}})"), F.lit(1))
    run = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    hashed = run.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return hashed.select(F.when(F.pmod("h", F.lit(typo)) == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least)


def codes(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of letter numbers."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length)
    return np.where(points < FIRST, points - ord("a"), points - FIRST + 26).astype(np.uint8)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """Counts of each letter."""
    rows = np.arange(len(letters))[:, None] * LETTERS
    return np.bincount((rows + letters).ravel(), minlength=len(letters) * LETTERS).reshape(-1, LETTERS).astype(np.int16)


def _cut(counts: np.ndarray) -> tuple[int, int] | None:
    """Letter and count to split at (up to it, above it): the widest letter's middle, if it splits at all."""
    for letter in np.argsort(-counts.astype(np.float32).var(0), kind="stable")[:4]:
        values = counts[:, letter]
        at = int(np.median(values))
        at = at if (values > at).any() else at - 1
        if (values <= at).any() and (values > at).any():
            return int(letter), at
    return None


def upper_tree(counts: np.ndarray, cells: int) -> list:
    """Cuts down to about ``cells`` cells: [letter, at, left, right], or an empty list for a cell."""
    cut = _cut(counts) if cells > 1 and len(counts) > 1 else None
    if cut is None:
        return []
    letter, at = cut
    left = counts[:, letter] <= at
    share = min(cells - 1, max(1, round(cells * left.mean())))
    return [letter, at, upper_tree(counts[left], share), upper_tree(counts[~left], cells - share)]


def touched(tree: list, counts: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for each cell that a row's range touches; ``reach`` 0 gives each row its own cell."""
    rows, cells, number = [], [], 0

    def go(node: list, at: np.ndarray, gaps: dict[int, np.ndarray]) -> None:
        nonlocal number
        if not node:
            rows.append(at)
            cells.append(np.full(len(at), number, np.int32))
            number += 1
            return
        letter, bound, left, right = node
        value = counts[at, letter].astype(np.int32)
        for child, gap in ((left, value - bound), (right, bound + 1 - value)):
            inner = gaps | {letter: np.maximum(gap, gaps.get(letter, 0))}  # one gap a letter, however often it is cut
            near = sum(np.maximum(g, 0) for g in inner.values()) <= reach
            go(child, at[near], {k: g[near] for k, g in inner.items()})

    go(tree, np.arange(len(counts)), {})
    return np.concatenate(rows), np.concatenate(cells)


def leaves(counts: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list, np.ndarray, np.ndarray]:
    """Order of rows by leaf, nodes (first row, past the last, two children or -1), and the boxes of all nodes."""
    order: list[np.ndarray] = []
    nodes: list[list[int]] = []

    def build(rows: np.ndarray, first: int) -> int:
        me = len(nodes)
        nodes.append([first, first + len(rows), -1, -1])
        cut = _cut(counts[rows]) if len(rows) > leaf else None
        if cut is None:
            order.append(rows)
        else:
            under = counts[rows, cut[0]] <= cut[1]
            nodes[me][2] = build(rows[under], first)
            nodes[me][3] = build(rows[~under], first + int(under.sum()))
        return me

    build(np.arange(len(counts)), 0)
    ordered = np.concatenate(order)
    table_ = np.array(nodes)
    low, high = np.empty((len(table_), LETTERS), np.int16), np.empty((len(table_), LETTERS), np.int16)
    for i in range(len(table_) - 1, -1, -1):
        first, last, left, right = table_[i]
        if left < 0:
            low[i], high[i] = counts[ordered[first:last]].min(0), counts[ordered[first:last]].max(0)
        else:
            low[i], high[i] = np.minimum(low[left], low[right]), np.maximum(high[left], high[right])
    return ordered, table_, low, high


#: A bit for each letter's first, second, ... eighth occurrence, some shared.
_BITS = np.uint64(1) << (np.random.default_rng(0).integers(0, 64, (LETTERS, 9)).astype(np.uint64))


def signatures(counts: np.ndarray) -> np.ndarray:
    """64 bits for each row: rows differ in no more bits than their counts differ (L1), since each step of a count turns one bit."""
    out = np.zeros(len(counts), np.uint64)
    for letter in np.flatnonzero(counts.any(0)):
        values = counts[:, letter]
        for level in range(1, min(int(values.max()), 8) + 1):
            out ^= np.where(values >= level, _BITS[letter, level], np.uint64(0))
    return out


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows that differ by one replaced letter, or by one that ``a`` has more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    same_front = np.cumprod(a[:, :-1] == b, axis=1).sum(1)
    same_back = np.cumprod((a[:, 1:] == b)[:, ::-1], axis=1).sum(1)
    return same_front + same_back >= b.shape[1]


def near_pairs(data: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(data row, query row) of all words one edit apart; the queries are as long as the data, or one letter shorter."""
    shorter = data.shape[1] - queries.shape[1]
    reach = 1 if shorter else 2
    counts, asked = letter_counts(data), letter_counts(queries)
    order, nodes, low, high = leaves(counts)
    q_order, q_nodes, q_low, q_high = leaves(asked)
    marks, q_marks = signatures(counts)[order], signatures(asked)[q_order]
    for leaf in np.flatnonzero(q_nodes[:, 2] < 0):
        front, found = np.array([0]), []
        while len(front):
            gap = np.maximum(low[front] - q_high[leaf], 0).sum(1) + np.maximum(q_low[leaf] - high[front], 0).sum(1)
            front = front[gap <= reach]
            ends = nodes[front, 2] < 0
            found.append(front[ends])
            front = nodes[front[~ends], 2:].ravel()
        ranges = nodes[np.concatenate(found), :2]
        if not len(ranges):
            continue
        every = np.concatenate([np.arange(a, b) for a, b in ranges])
        for start in range(*q_nodes[leaf, :2], LEAF):  # words of the same letters fill a leaf of any size
            q_at = np.arange(start, min(start + LEAF, q_nodes[leaf, 1]))
            for at in np.split(every, range(COMPARED, len(every), COMPARED)):
                i, j = np.nonzero(np.bitwise_count(marks[at][:, None] ^ q_marks[q_at][None, :]) <= reach)
                d, q = order[at[i]], q_order[q_at[j]]
                good = one_edit(data[d], queries[q])
                if good.any():
                    yield d[good], q[good]


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE, most_cells: int = CELLS) -> DataFrame:
    """``word, n_near, best_n, best`` of every word of ``words`` (word, n) that has a near word; best: the largest n, ties the smallest word."""
    spark = words.sparkSession
    sizes = {r["length"]: r["n"] for r in words.groupBy(F.char_length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    total = sum(sizes.values())
    cell = max(cell, -(-total // most_cells))
    every = max(1, total // sample)
    big = [length for length, n in sizes.items() if n > cell]
    drawn = [r["word"] for r in words.where(F.char_length("word").isin(big) & (F.pmod(F.xxhash64("word"), F.lit(every)) == 0)).select("word").limit(4 * sample).collect()] if big else []
    by_length: dict[int, list[str]] = {}
    for word in drawn:
        by_length.setdefault(len(word), []).append(word)
    trees = {length: upper_tree(letter_counts(codes(of, length)), -(-sizes[length] // cell)) for length, of in by_length.items()}
    shared = spark.sparkContext.broadcast((trees, set(sizes)))

    def route(asked: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, known = shared.value
            for batch in batches:
                word, n = batch.column("word").to_pylist(), np.asarray(batch.column("n"))
                lengths = np.array([len(w) for w in word])
                for length in np.unique(lengths):
                    at = np.flatnonzero(lengths == length)
                    counts = letter_counts(codes([word[i] for i in at], int(length)))
                    for other, reach in ((int(length), 2), (int(length) + 1, 1)) if asked else ((int(length), 0),):
                        if other not in known:
                            continue
                        row, cell_no = touched(trees.get(other, []), counts, reach)
                        rows = at[row]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), other, np.int32)), pa.array(cell_no), batch.column("word").take(pa.array(rows)), pa.array(n[rows])], ["length", "cell", "word", "n"])

        return run

    kind = "length int, cell int, word string, n bigint"
    data = written(words.select("word", "n").mapInArrow(route(False), kind), "spelling-data")
    crowded = data.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 2 * cell).collect()  # cells at most
    many = F.coalesce(F.create_map(*[x for r in crowded for x in (F.lit(f"{r['length']}:{r['cell']}"), F.lit(-(-r["rows"] // cell)))])[F.concat_ws(":", "length", "cell")], F.lit(1)) if crowded else F.lit(1)
    parted = data.withColumn("part", F.pmod(F.xxhash64("word"), many.cast("long")).cast("int"))
    asked = words.select("word", "n").mapInArrow(route(True), kind).withColumn("part", F.explode(F.sequence(F.lit(0), many.cast("int") - 1)))

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"word": [], "n_near": [], "best_n": [], "best": []}
        if len(left) and len(right):
            left = left.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
            length = int(left["length"].iloc[0])
            letters = codes(left["word"].tolist(), length)
            data_words, data_n = left["word"].to_numpy(), left["n"].to_numpy()
            right = right.assign(size=right["word"].str.len()).sort_values(["size", "n", "word"], ascending=[True, False, True], ignore_index=True)
            for size, of in right.groupby("size"):
                # Best words of the data among themselves, and of the other side: rows are ranked, so the best is the smallest row.
                near, best = np.zeros(len(left), np.int64), np.full(len(left), len(right), np.int64)
                for start in range(0, len(of), QUERIES):
                    block = of.iloc[start : start + QUERIES]
                    q_words, q_n = block["word"].to_numpy(), block["n"].to_numpy()
                    q_near, q_best = np.zeros(len(block), np.int64), np.full(len(block), len(left), np.int64)
                    for d, q in near_pairs(letters, codes(q_words.tolist(), int(size))):
                        np.add.at(q_near, q, 1)
                        np.minimum.at(q_best, q, d)
                        if size != length:  # found from the shorter side only
                            np.add.at(near, d, 1)
                            np.minimum.at(best, d, start + q)
                    has = np.flatnonzero(q_near)
                    for name, value in zip(out, (q_words[has], q_near[has], data_n[q_best[has]], data_words[q_best[has]]), strict=True):
                        out[name].append(value)
                has = np.flatnonzero(near)
                for name, value in zip(out, (data_words[has], near[has], of["n"].to_numpy()[best[has]] if len(has) else [], of["word"].to_numpy()[best[has]] if len(has) else []), strict=True):
                    out[name].append(value)
        made = {name: np.concatenate(values) if values else [] for name, values in out.items()}
        return pd.DataFrame(made).astype({"word": "object", "n_near": "int64", "best_n": "int64", "best": "object"})

    keys = ("length", "cell", "part")
    found = parted.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(solve, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def spelling_groups(words: DataFrame, factor: int = FORM_FACTOR, cell: int = CELL) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``words`` (word, n; a word once, of a-z and U+00C0 to U+00FF)."""
    words = written(words.select("word", "n"), "spelling-words")
    near = near_words(words, cell=cell)
    is_form = F.col("best_n") >= factor * F.col("n")
    joined = words.join(near, "word", "left")
    known = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-forms")
    # Counts grow by the factor with each step, so the longest way is known; words without a form end it.
    most, least = known.agg(F.max("n"), F.min("n")).first()
    steps = max(0, math.floor(math.log(most / max(1, least), factor) + 1e-9) - 1) if most else 0
    ways = known.where("form is not null").select("word", F.col("form").alias("root"))
    step = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
    for _ in range(steps):
        ways = ways.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    out = known.where("form is null").withColumn("root", F.col("word")).unionByName(known.where("form is not null").join(ways, "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling_groups(spark, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    runs = with_typos(table(spark, sf_dir, "documents"))
    return spelling_groups(runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT))
