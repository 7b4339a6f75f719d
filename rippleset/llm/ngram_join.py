"""Jaccard join of documents on word shingles, by prefix filters under several global token orders.

A pair that links shares a token in the prefixes of both sets under every global order, so a candidate must pass all
orders; only then are its sets compared. All orders put the counted frequent shingles last (rarer first) and differ in the hash
that orders the rest. The first order makes the candidates, the others are intersected with it before verification.

A list of documents that share a prefix token is not expanded into pairs. Every list names a leader; its members are verified against
it, which joins a group of near copies by a star. Then stars' centres (hubs) of one list are compared where their classes differ, and
block by block the members of two stars whose classes still differ, where the triangle inequality of the Jaccard distance leaves a link
possible. That is how all links are counted (``count_links``), which also compares the members within each star; documents with equal
sets count one another by the size of their group.

The classes alone need no comparison within a class: only lists that hold several classes after the stars go on. The documents of
longer lists are listed anew, by an order that counts all tokens of just these documents, so that what a copy changed comes first.
A document stays in a list only if the tokens from there on could suffice for a link (a pair is met in the list of its first common
token). The rest are verified against the list's document with the earliest place, and what is still of different classes pair by pair.

Cases: a null or wordless text has an empty set and links with nothing. Fewer words than a shingle are one token. Equal sets are linked
without verification. Rows of one id are one document; rows with a null id link with nothing and get a null class.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleset.llm.common import in_small_batches, slices, table, written

#: Different texts that make a shingle frequent, and the most frequent shingles that are known to all tasks (12 bytes each).
FREQUENT, MAX_FREQUENT = 2, 1 << 21
#: Ids up to which a list of documents is broadcast to the texts instead of shuffling these.
FEW = 100_000
#: Rows of a list from which its documents are listed anew, by an order that counts all their tokens.
CROWD = 16
#: Counted are the tokens that can come into a prefix: this share of a set, smallest hashes first.
COUNTED = 0.4
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20
#: Sets and tokens of a star's block, on average, and shared tokens that two blocks are compared by at a time.
BLOCK_SETS, BLOCK_TOKENS, COLUMNS = 256, 1 << 19, 1 << 14
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray, by: np.uint64 = _M1) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * by
    return x ^ (x >> np.uint64(29))


def _hashed(raw: bytes) -> np.ndarray:
    """Hashes of the words of one block: sums of mixed (place in the word, lower-case byte) values."""
    chars = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[chars]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    if not len(edges):
        return np.empty(0, np.uint64)
    lengths = edges[1::2] - edges[::2]
    first = np.cumsum(lengths) - lengths
    chars = _LOWER[chars[inside]]
    place = (np.arange(len(chars)) - np.repeat(first, lengths)).astype(np.uint64)
    return np.add.reduceat(_mix(_mix((place << np.uint64(8)) + chars + np.uint64(1)), _M2), first)


def word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of a text's words, in order; long texts go by blocks that end at white space."""
    at, parts = 0, [np.empty(0, np.uint64)]
    while at < len(raw):
        gap = _GAP.search(raw, at + BLOCK)
        end = gap.end() if gap else len(raw)
        parts.append(_hashed(raw[at:end]))
        at = end
    return np.concatenate(parts)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Hashes of a text's distinct shingles, ascending."""
    w = word_hashes((text or "").encode())
    if not len(w):
        return w
    width = min(size, len(w))
    out = w[: len(w) - width + 1] + np.uint64(width)
    for k in range(1, width):
        out = _mix(out) + w[k : len(w) - width + 1 + k]
    out = np.sort(_mix(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


class Orders:
    """Global token orders: by a hash, the frequent shingles last, rarer first."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        by = np.argsort(frequent)
        self.frequent, self.counts = frequent[by], counts[by].astype(np.int32)  # 12 bytes each

    def prefix(self, tokens: np.ndarray, length: int, order: int) -> np.ndarray:
        """The first ``length`` tokens of a set under one of the orders."""
        if order == 0:  # tokens ascend by this order's hash, so the prefix often lies within the first few
            head = tokens[: length + length // 4 + 8]
            rare = head[self.count(head) == 0]
            if len(rare) >= length:
                return rare[:length]
        count = self.count(tokens)
        key = tokens if order == 0 else _mix(tokens, np.uint64((2 * order + 1) * int(_M2) & 0xFFFFFFFFFFFFFFFF))
        rare = np.flatnonzero(count == 0)
        if len(rare) > length:
            return tokens[rare[np.argpartition(key[rare], length)[:length]]]
        return tokens[np.lexsort((key, count))[:length]]

    def count(self, tokens: np.ndarray) -> np.ndarray:
        """Counts of the frequent ones among tokens, 0 of the others."""
        if not len(self.frequent):
            return np.zeros(len(tokens), np.int32)
        at = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
        return np.where(self.frequent[at] == tokens, self.counts[at], 0)


def prefix_length(n: int, percent: int) -> int:
    """Tokens of which a partner at ``percent`` or more must share one."""
    return n - -(-percent * n // 100) + 1


def frequent_shingles(docs: DataFrame, size: int, frequent: int = FREQUENT, most: int = MAX_FREQUENT, share: float = COUNTED) -> Orders:
    """Counts over all documents, each task adding up its own first; the ``most`` frequent ones at most are kept."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, volume = [], 0

        def summed() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int32))], ["token", "n"])

        for batch in slices(batches):
            for text in batch.column(1).to_pylist():
                tokens = shingles(text, size)
                held.append(tokens[: math.ceil(share * len(tokens)) + 1])
                volume += len(held[-1])
            if volume > 1 << 20:
                yield summed()
                held, volume = [], 0
        if volume:
            yield summed()

    counted = docs.mapInArrow(count, "token bigint, n int").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent)
    counted = written(counted, "frequent-shingles")
    levels = sorted(((r["level"], r["rows"]) for r in counted.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True)
    room, least = most, None
    for level, rows in levels:
        room -= rows
        if room < 0:
            break
        least = level
    kept = (counted.where(F.floor(F.log2("n")) >= least) if least is not None else counted.limit(0)).toArrow()  # at most ``most`` rows
    return Orders(kept.column("token").to_numpy().astype(np.int64).view(np.uint64), kept.column("n").to_numpy().astype(np.int64))


def shared_prefixes(docs: DataFrame, orders, size: int, percent: int) -> DataFrame:
    """``kind``, ``token``, ``id``, ``n``, ``leader``.

    Kind 0: documents that share a token of their first-order prefix, and the smallest of them. Kind 1: every document with its set's digest as
    ``token``, and the smallest document of that set. Kind 2: documents without a set. The rows of a token are sorted by Spark and
    passed through, never held.
    """

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = orders.value
        for batch in slices(batches):
            rows, made = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                tokens = shingles(text, size)
                n = len(tokens)
                if not n or not batch.column(0)[row].is_valid:
                    digest = np.array([row], np.uint64)
                    kind, first = np.array([2], np.int8), np.empty(0, np.uint64)
                else:
                    digest = np.array([xxhash.xxh3_64_intdigest(tokens.tobytes())], np.uint64)
                    kind, first = np.array([1], np.int8), known.prefix(tokens, prefix_length(n, percent), 0)
                rows.append(np.full(1 + len(first), row, np.int32))
                made.append((np.concatenate([kind, np.zeros(len(first), np.int8)]), np.concatenate([digest, first]), np.full(1 + len(first), n, np.int32)))
            if rows:
                kinds, tokens, sizes = (np.concatenate(x) for x in zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(tokens.view(np.int64)), batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(sizes)], ["kind", "token", "id", "n"])

    def lead(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leader, waiting = None, None, None  # the open group, and its first row while it is alone
        for batch in batches:
            kind, token, ids, n = (np.asarray(batch.column(i).fill_null(0)) for i in range(4))
            valid = np.asarray(batch.column(2).is_valid())
            if not len(kind):
                continue
            new = np.concatenate([[(last is None) or (last != (kind[0], token[0]))], (kind[1:] != kind[:-1]) | (token[1:] != token[:-1])]) | (kind == 2)
            first = np.maximum.accumulate(np.where(new, np.arange(len(kind)), -1))
            leaders = np.where(first >= 0, ids[np.maximum(first, 0)], leader if leader is not None else 0)
            alone = new & np.concatenate([new[1:], [True]]) & (kind == 0)
            if waiting is not None and not new[0]:
                yield pa.RecordBatch.from_pylist([waiting], schema=schema)
            waiting = None
            if alone[-1]:  # may go on in the next batch
                waiting = {"kind": 0, "token": int(token[-1]), "id": int(ids[-1]), "n": int(n[-1]), "leader": int(leaders[-1])}
            keep = np.flatnonzero(~alone)
            yield pa.RecordBatch.from_arrays([pa.array(kind[keep]), pa.array(token[keep]), pa.array(ids[keep], mask=~valid[keep]), pa.array(n[keep]), pa.array(leaders[keep], mask=~valid[keep])], schema=schema)
            last, leader = (kind[-1], token[-1]), leaders[-1]

    schema = pa.schema([("kind", pa.int8()), ("token", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("leader", pa.int64())])
    posted = docs.mapInArrow(post, "kind tinyint, token bigint, id bigint, n int")
    sorted_rows = posted.repartition("kind", "token").sortWithinPartitions("kind", "token", "id")
    return written(sorted_rows.mapInArrow(lead, "kind tinyint, token bigint, id bigint, n int, leader bigint"), "shared-prefixes")


def _listed(docs: DataFrame, ids: DataFrame, how: str, few: int) -> DataFrame:
    """Documents that are, or are not, in a list of ids (``_need``); up to ``few`` ids are broadcast, more are shuffled."""
    ids = written(ids, "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= few else ids, docs["id"] == ids["_need"], how)


def _sets(docs: DataFrame, ids: DataFrame, size: int, few: int) -> DataFrame:
    """``id``, ``tokens`` (bytes of the ascending hashes) of listed documents."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, size).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["id", "tokens"])

    return written(_listed(docs, ids, "left_semi", few).select("id", "_text").mapInArrow(sets, "id bigint, tokens binary"), "sets")


def verified(docs: DataFrame, sizes: DataFrame, pairs: DataFrame, orders, size: int, percent: int, n_orders: int, few: int = FEW) -> DataFrame:
    """``a``, ``b``, ``distance``, ``linked`` of candidate pairs.

    Pairs whose set sizes rule out a link are not fetched; their distance is the least that the sizes allow.
    """
    sized = pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    sized = written(sized.withColumn("fits", 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")), "candidates")
    unfit = sized.where("not fits").select("a", "b", (1 - F.least("na", "nb") / F.greatest("na", "nb")).alias("distance"), F.lit(False).alias("linked"))
    pairs = sized.where("fits").select("a", "b")
    ids = pairs.select(F.col("a").alias("_need")).union(pairs.select("b")).distinct()

    needed = _sets(docs, ids, size, few)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = orders.value
        for batch in slices(batches):
            out = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                lengths = prefix_length(len(x), percent), prefix_length(len(y), percent)
                possible = True
                for order in range(1, n_orders):
                    possible = possible and bool(np.intersect1d(known.prefix(x, lengths[0], order), known.prefix(y, lengths[1], order), assume_unique=True).size)
                # Pairs that fail a filter can't link; their distance still serves the triangle inequality.
                both = np.intersect1d(x, y, assume_unique=True).size
                out.append((1 - both / (len(x) + len(y) - both), possible and 100 * both >= percent * (len(x) + len(y) - both)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d for d, _ in out]), pa.array([bool(k) for _, k in out])], ["a", "b", "distance", "linked"])

    second = pairs.join(needed.select(F.col("id").alias("b"), F.col("tokens").alias("of_b")), "b")
    rows = second.join(needed.select(F.col("id").alias("a"), F.col("tokens").alias("of_a")), "a").select("a", "b", "of_a", "of_b")
    return written(rows.mapInArrow(compare, "a bigint, b bigint, distance double, linked boolean").unionByName(unfit), "verified")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Tokens that each set of the one list shares with each of the other, as a matrix."""
    sides = []
    for sets in (left, right):
        tokens, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        by = np.argsort(tokens)
        sides.append((tokens[by], row[by]))
    both = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(both), COLUMNS):
        part, dense = both[at : at + COLUMNS], []
        for (tokens, row), sets in zip(sides, (left, right), strict=True):
            lo, hi = np.searchsorted(tokens, part[0]), np.searchsorted(tokens, part[-1], "right")
            tokens, row = tokens[lo:hi], row[lo:hi]
            place = np.searchsorted(part, tokens)
            hit = part[place] == tokens
            matrix = np.zeros((len(sets), len(part)), np.float32)
            matrix[row[hit], place[hit]] = 1
            dense.append(matrix)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def link_tally(docs: DataFrame, members: DataFrame, work: DataFrame, size: int, percent: int, few: int = FEW) -> DataFrame:
    """All links between the sets of two stars (``work``: ``a``, ``b``, ``blocks_a``, ``blocks_b``; one star if ``a`` = ``b``).

    Rows ``a``, null, ``n``: a set and the documents that it links with in one pair of blocks. Rows ``a``, ``b``, null: classes that a link
    joins. Each pair of blocks is compared in its own group, so a large star is split over tasks and no row is made for a pair of sets.
    """
    blocks = work.select("a", "b", "blocks_b", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1)).alias("i"))
    blocks = blocks.select("a", "b", "i", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)).alias("j")).where("a <> b or i <= j")
    blocks = written(blocks, "block-pairs")
    stars = blocks.select(F.col("a").alias("hub")).union(blocks.select("b")).distinct()
    held = members.join(stars, "hub", "left_semi").select("hub", "id", "class", "copies", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
    held = written(held, "held")
    held = written(held.join(_sets(docs, held.select(F.col("id").alias("_need")).distinct(), size, few).dropDuplicates(["id"]), "id"), "held-sets")
    columns = ["a", "b", "i", "j", "side", "id", "class", "copies", "tokens"]
    left = blocks.join(held.select(F.col("hub").alias("a"), F.col("block").alias("i"), "id", "class", "copies", "tokens"), ["a", "i"]).withColumn("side", F.lit(0)).select(columns)
    right = blocks.where("a <> b or i <> j").join(held.select(F.col("hub").alias("b"), F.col("block").alias("j"), "id", "class", "copies", "tokens"), ["b", "j"]).withColumn("side", F.lit(1)).select(columns)

    def tally(given: pa.Table) -> pa.Table:
        side, ids, group, copies = (given.column(x).to_numpy() for x in ("side", "id", "class", "copies"))
        sets = [np.frombuffer(x, np.uint64) for x in given.column("tokens").to_pylist()]
        n = np.array([len(x) for x in sets])
        x = np.flatnonzero(side == 0)
        within = given.column("a")[0] == given.column("b")[0] and given.column("i")[0] == given.column("j")[0]
        y = x if within else np.flatnonzero(side == 1)
        if not len(x) or not len(y):
            return pa.table({"a": [], "b": [], "n": []}, schema=schema)
        both = common_counts([sets[k] for k in x], [sets[k] for k in y])
        linked = 100 * both >= percent * (n[x][:, None] + n[y][None, :] - both)
        if within:
            np.fill_diagonal(linked, False)
        found = [(ids[x], linked @ copies[y])] + ([] if within else [(ids[y], linked.T @ copies[x])])
        at, to = np.nonzero(linked & (group[x][:, None] != group[y][None, :]))
        joins = np.unique(np.stack([group[x][at], group[y][to]], 1), axis=0)
        counted = np.concatenate([k for k, _ in found])
        return pa.table({
            "a": pa.array(np.concatenate([counted, joins[:, 0]])),
            "b": pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(joins[:, 1])]),
            "n": pa.concat_arrays([pa.array(np.concatenate([k for _, k in found])), pa.nulls(len(joins), pa.int64())]),
        }, schema=schema)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
    return written(left.union(right).groupBy("a", "b", "i", "j").applyInArrow(tally, "a bigint, b bigint, n bigint"), "tally")


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``class`` (smallest id reachable) of all ids in edges ``a``, ``b``: large and small stars in turn until nothing moves."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", "m"))
        edges = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            return edges.groupBy("u").agg(F.min("v").alias("class")).withColumnRenamed("u", "id")
        state = now


def _classed(df: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    """``df`` with the ``class`` of the documents in a column; those without a link are a class of their own."""
    return df.join(classes.select(F.col("id").alias(column), "class"), column, "left").withColumn("class", F.coalesce("class", column))


def _sets_of_documents(shared: DataFrame, again: DataFrame) -> DataFrame:
    """``id``, ``n``, ``set_id`` of every document, copies included."""
    every = shared.where("kind > 0").select("id", "n", F.col("leader").alias("set_id"))
    every = every.union(again.join(every.withColumnRenamed("id", "first").dropDuplicates(["first"]), "first").select("id", "n", F.when(F.col("n") > 0, F.col("set_id")).otherwise(F.col("id"))))
    return written(every, "sets-of-documents")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of lists that hold several classes, with the list's ``rows``, its ``least`` set size and the most ``texts`` of one id."""
    of = rows.groupBy("token").agg(F.min("class").alias("c"), F.max("class").alias("d"), F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"), F.max("texts").alias("most_texts"))
    return rows.join(of.where("c <> d").drop("c", "d"), "token")


def placed_prefixes(docs: DataFrame, orders, size: int, percent: int) -> DataFrame:
    """``token``, ``id``, ``place`` (from 0) of every document's prefix, rarest first."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = orders.value
        for batch in slices(batches):
            found = [np.empty(0, np.uint64)]
            for text in batch.column(1).to_pylist():
                tokens = shingles(text, size)
                found.append(tokens[np.lexsort((tokens, known.count(tokens)))[: prefix_length(len(tokens), percent) if len(tokens) else 0]])
            sizes = [len(x) for x in found[1:]]
            rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            places = pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in [0, *sizes]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), batch.column(0).take(rows), places], ["token", "id", "place"])

    return docs.select("id", "_text").mapInArrow(place, "token bigint, id bigint, place int")


def _may_link(of: str, percent: int):
    """Whether sizes and tokens that others hold too leave a link possible between a row and one with its columns named ``of``."""
    both, total = F.least("most", f"most{of}"), F.col("n") + F.col(f"n{of}")
    return (F.col("class") != F.col(f"class{of}")) & (100 * F.least("n", f"n{of}") >= percent * F.greatest("n", f"n{of}")) & (100 * both >= percent * (total - both))


def open_lists(docs: DataFrame, rows: DataFrame, size: int, percent: int, most: int = MAX_FREQUENT, few: int = FEW) -> DataFrame:
    """Rows of lists (``token``, ``id``, ``class``, ``n``, ``texts``) that may link across classes, with the ``most`` tokens to share and a ``centre``.

    Lists under ``CROWD`` rows stay as they are. Ids with several texts have no bound. The centre is the row with the earliest place.
    """
    mixed = written(_mixed(rows).drop("least", "most_texts"), "mixed")
    crowd = written(_listed(docs, mixed.where(F.col("rows") >= CROWD).select(F.col("id").alias("_need")).distinct(), "left_semi", few).select("id", "_text"), "crowd")
    orders = docs.sparkSession.sparkContext.broadcast(frequent_shingles(crowd, size, 2, most, 1.0))  # bounded by ``most``
    known = mixed.select("id", "class", "n", "texts").distinct()
    bound = F.col("n") - F.when(F.col("texts") == 1, F.col("place")).otherwise(0)
    again = placed_prefixes(crowd, orders, size, percent).join(known, "id").select("token", "id", "class", "n", "texts", bound.alias("most"))
    rows = mixed.where(F.col("rows") < CROWD).select("token", "id", "class", "n", "texts", F.col("n").alias("most")).union(again)
    partner = F.when(F.col("most_texts") == 1, F.greatest("least", F.ceil(percent * F.col("n") / 100))).otherwise(0)
    held = _mixed(rows).where(100 * F.col("most") >= percent * (F.col("n") + partner - F.col("most"))).drop("rows", "least", "most_texts")
    held = written(held, "held-lists")
    centre = held.groupBy("token").agg(F.min(F.struct(1 - F.col("most") / F.col("n"), "id", "class", "n", "most")).alias("centre"))
    return written(_mixed(held).drop("rows", "least", "most_texts").join(centre, "token"), "open-lists")


def centre_pairs(held: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` of a list's centre and its rows of other classes."""
    pairs = held.select("id", "class", "n", "most", F.col("centre.id").alias("id2"), F.col("centre.class").alias("class2"), F.col("centre.n").alias("n2"), F.col("centre.most").alias("most2"))
    return pairs.where(_may_link("2", percent)).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def across_classes(held: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` of other rows of a list that are still of different classes."""
    rows = _classed(held.where(F.col("id") != F.col("centre.id")).drop("class", "centre"), classes, "id")
    rows = written(_mixed(rows).select("token", "id", "class", "n", "most"), "apart")
    other = rows.select("token", *(F.col(x).alias(f"{x}2") for x in ("id", "class", "n", "most")))
    return rows.join(other, "token").where((F.col("id") < F.col("id2")) & _may_link("2", percent)).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


@in_small_batches
def near_classes(df: DataFrame, size: int = 5, percent: int = 75, n_orders: int = 3, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, most: int = MAX_FREQUENT, few: int = FEW, count_links: bool = False) -> DataFrame:
    """``id_col`` (long), ``n_shingles`` and ``component_id`` of every row; with ``count_links`` also ``n_links``, the other documents at ``percent`` or more.

    The classes alone need no comparison within a class; counting all links does, and costs the square of a group of near copies.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("_text"))

    # Equal texts are one document from here on, the one of the smallest id.
    keyed = docs.select("id", F.md5(F.coalesce("_text", F.lit(""))).alias("_key"))
    firsts = keyed.groupBy("_key").agg(F.min("id").alias("first"), F.max("id").alias("_last")).where("first <> _last").select("_key", "first")
    again = written(keyed.join(firsts, "_key").where("id <> first").select("id", "first"), "equal-texts")
    docs = _listed(docs, again.select(F.col("id").alias("_need")).distinct(), "left_anti", few)

    orders = spark.sparkContext.broadcast(frequent_shingles(docs, size, frequent, most))  # bounded by ``most``
    shared = shared_prefixes(docs, orders, size, percent)
    sizes = shared.where("kind = 1").groupBy("id").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    moved = shared.where("kind = 1 and id <> leader").select("id", F.col("leader").alias("set_id")).distinct()

    # Lists of the sets' first documents: copies stand aside.
    lists = shared.where("kind = 0").select("token", "id", "leader").join(moved, "id", "left").select("token", F.coalesce("set_id", "id").alias("id"), "leader")
    lists = lists.join(moved.select(F.col("id").alias("leader"), F.col("set_id").alias("lead_set")), "leader", "left").select("token", "id", F.coalesce("lead_set", "leader").alias("leader")).distinct()
    lists = written(lists, "lists")
    stars = lists.where("id <> leader").select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b"), "leader").distinct()
    first = verified(docs, sizes, stars.select("a", "b").distinct(), orders, size, percent, n_orders, few)
    links = first.where("linked").select("a", "b")
    every = _sets_of_documents(shared, again)
    if not count_links:
        held = open_lists(docs, _classed(lists.select("token", "id"), components(links), "id").join(sizes, "id"), size, percent, most, few)
        seen = first.select("a", "b")
        second = verified(docs, sizes, centre_pairs(held, percent).join(seen, ["a", "b"], "left_anti"), orders, size, percent, n_orders, few)
        links, seen = links.union(second.where("linked").select("a", "b")), seen.union(second.select("a", "b"))
        third = verified(docs, sizes, across_classes(held, components(links), percent).join(seen, ["a", "b"], "left_anti"), orders, size, percent, n_orders, few)
        classes = components(links.union(third.where("linked").select("a", "b")))
        out = every.join(classes.withColumnRenamed("id", "set_id"), "set_id", "left")
        return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("class", "set_id").alias("component_id"))

    # Each set's hub: the smallest leader that it links with, or itself.
    to_hub = first.where("linked").join(stars, ["a", "b"]).select(F.when(F.col("leader") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("id"), "leader", "distance")
    hubs = to_hub.groupBy("id").agg(F.min(F.struct("leader", "distance")).alias("h")).select("id", F.col("h.leader").alias("hub"), F.col("h.distance").alias("away"))
    placed = written(lists.select("token", "id").join(hubs, "id", "left").select("token", "id", F.coalesce("hub", "id").alias("hub"), F.coalesce("away", F.lit(0.0)).alias("away")), "placed")

    # Between hubs that share a list.
    centres = placed.select("token", "hub").distinct()
    between = centres.join(centres.select("token", F.col("hub").alias("hub2")), "token").where("hub < hub2").select(F.col("hub").alias("a"), F.col("hub2").alias("b")).distinct()
    between = written(between, "hub-pairs")
    fresh = written(between.join(first.select("a", "b"), ["a", "b"], "left_anti"), "fresh-pairs")
    second = verified(docs, sizes, fresh, orders, size, percent, n_orders, few)
    links = links.union(second.where("linked").select("a", "b"))
    classes = components(links)

    copies = every.where("n > 0").select("set_id", "id").distinct().groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"))

    # Between members of one star and of two stars, where a link is possible.
    members = placed.select("id", "hub", "away").distinct().join(sizes, "id").join(copies.withColumnRenamed("set_id", "id"), "id").join(classes, "id", "left")
    members = written(members.withColumn("class", F.coalesce("class", "id")), "members")
    star = members.groupBy("hub").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens"))
    star = written(star.select("hub", "radius", "rows", F.ceil(F.greatest(F.col("rows") / BLOCK_SETS, F.col("tokens") / BLOCK_TOKENS)).cast("int").alias("blocks")), "stars-of-sets")
    known = first.select("a", "b", "distance", "linked").union(second.select("a", "b", "distance", "linked"))
    one, two = (star.select(F.col("hub").alias(x), F.col("radius").alias(f"radius_{x}"), F.col("blocks").alias(f"blocks_{x}")) for x in "ab")
    reach = written(between.join(known, ["a", "b"]).join(one, "a").join(two, "b"), "reach")
    alone = F.col("radius_a") + F.col("radius_b") == 0  # two stars of one set each: verified already
    least = 1 - percent / 100 + 1e-9
    across = reach.where(~alone & (F.col("distance") - F.col("radius_a") - F.col("radius_b") <= least)).select("a", "b", "blocks_a", "blocks_b")
    work = across.union(star.where("rows > 1").select("hub", "hub", "blocks", "blocks"))
    tally = link_tally(docs, members.join(star.select("hub", "blocks"), "hub"), work, size, percent, few)

    links = links.union(tally.where("n is null").select("a", "b"))
    classes = components(links)
    sure = reach.where(alone & F.col("linked")).select("a", "b")
    sure = sure.union(sure.select("b", "a")).toDF("id", "set_id").join(copies, "set_id").select("id", F.col("copies").alias("n"))
    found = tally.where("n is not null").select(F.col("a").alias("id"), "n").union(sure).groupBy("id").agg(F.sum("n").alias("found"))
    degree = copies.join(found.withColumnRenamed("id", "set_id"), "set_id", "left").select("set_id", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = every.join(classes.withColumnRenamed("id", "set_id"), "set_id", "left").join(degree, "set_id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("class", "set_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``df`` with one row of each class: of its smallest id, and of that id's texts the smallest. Rows with a null id stay.

    Rows, not ids, are classed, so a text that shares its id with a copy of another document stays if it is like nothing. Of rows that
    repeat id and text one stays, without words too.
    """
    keyed = written(df.select(F.struct(*(F.col(c) for c in df.columns)).alias("row"), F.monotonically_increasing_id().alias("key")), "keyed-rows")
    given = keyed.select("key", F.col("row")[id_col].cast("long").alias("id"), F.col("row")[text_col].cast("string").alias("text"))
    known = given.where("id is not null")
    classes = near_classes(known, id_col="key", text_col="text", **params).select("key", "component_id", (F.col("n_shingles") == 0).alias("empty"))
    # A text without words is like nothing but itself under its id.
    group = F.when(F.col("empty"), F.concat_ws(":", F.lit("id"), "id", F.md5(F.coalesce("text", F.lit(""))), F.col("text").isNull().cast("string"))).otherwise(F.concat(F.lit("class:"), F.col("component_id").cast("string")))
    first = known.join(classes, "key").groupBy(group.alias("group")).agg(F.min(F.struct("id", F.md5(F.coalesce("text", F.lit(""))).alias("text"), "key")).alias("first"))
    kept = first.select(F.col("first.key").alias("key")).union(given.where("id is null").select("key"))
    return keyed.join(kept, "key", "left_semi").select("row.*")


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Class of near documents of every document."""
    out = near_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")
