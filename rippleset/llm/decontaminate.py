"""Benchmark decontamination with an FM-index for each training shard.

A task cuts its documents into shards of bounded size. A shard's words that occur in no test phrase become one separator and
stretches too short for any phrase are left out, since no occurrence can touch them. Over the rest it builds a suffix array,
the Burrows-Wheeler transform and its wavelet tree; all test phrases are searched backwards at once by
wavelet-tree ranks, found rows are located by walking to the next sampled suffix position, and the words under occurrences are
merged into removal spans.

Cases: a null or wordless text has no words, and an item without words no phrase. An item of fewer words than a window is
one phrase. Items that share a phrase all count. Repeated rows are treated alike; a null item id reads as the empty string. A benchmark
above ``MAX_PHRASE_WORDS`` is searched in several passes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleset.llm.common import slices, table

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of one shard, and words of test phrases that one pass carries to the tasks.
SHARD_WORDS, MAX_PHRASE_WORDS = 1 << 20, 1 << 21
SAMPLE = 8


class WaveletTree:
    """Access and rank over integer symbols: one bit vector with counts for each bit, rows partitioned by it."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each row."""
        start, end = np.zeros_like(before), before
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            start = np.where(bit, zeros + ones[start], start - ones[start])
            end = np.where(bit, zeros + ones[end], end - ones[end])
        return end - start

    def access(self, row: np.ndarray) -> np.ndarray:
        """The symbols at rows."""
        symbol = np.zeros_like(row)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[row + 1] - ones[row]
            symbol = symbol * 2 + bit
            row = np.where(bit, zeros + ones[row], row - ones[row])
        return symbol


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order; a suffix that ends comes before one that goes on."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        key = (rank + 1) * (n + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


class FMIndex:
    """Backward search and location over one shard's symbols (1 and up; 0 separates)."""

    def __init__(self, text: np.ndarray):
        text = np.append(text.astype(np.int64) + 1, 0)  # 0 now ends the text, 1 separates
        order = suffix_array(text)
        self.tree = WaveletTree(text[order - 1])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.sampled = order % SAMPLE == 0
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]
        self.size = len(text)

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases given as rows of symbols, padded at the left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for k in range(phrases.shape[1]):
            symbol = phrases[:, -1 - k] + 1
            live = np.flatnonzero((k < sizes) & (low < high))
            known = symbol[live] < len(self.first) - 1
            high[live[~known]] = low[live[~known]]
            live = live[known]
            first = self.first[symbol[live]]
            low[live], high[live] = first + self.tree.rank(symbol[live], low[live]), first + self.tree.rank(symbol[live], high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled suffix, plus its position."""
        place, steps, open_rows = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_rows):
            done = self.sampled[rows[open_rows]]
            at = open_rows[done]
            place[at] = self.samples[self.sample_rank[rows[at]]] + steps
            open_rows = open_rows[~done]
            symbol = self.tree.access(rows[open_rows])
            rows[open_rows] = self.first[symbol] + self.tree.rank(symbol, rows[open_rows])
            steps += 1
        return place


class Phrases:
    """The test phrases of one pass: windows of words, with the items that hold them."""

    def __init__(self, items: Iterable[tuple[str, str]], window: int):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = WORD.findall((text or "").encode().lower())
            for at in range(max(1, len(words) - window + 1)) if words else ():
                owners[tuple(words[at : at + window])].add(item)
        self.codes = {word: code for code, word in enumerate(sorted({w for phrase in owners for w in phrase}), 1)}
        self.items = [sorted(x) for x in owners.values()]
        self.sizes = np.array([len(p) for p in owners], np.int64)
        self.symbols = np.zeros((len(owners), window), np.int64)
        for row, phrase in enumerate(owners):
            self.symbols[row, window - len(phrase) :] = [self.codes[w] for w in phrase]
        self.shortest = int(self.sizes.min(initial=window))

    def occurrences(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word and phrase of every occurrence in a shard, given each document's word codes."""
        sizes = np.array([len(w) for w in words], np.int64)
        text = np.zeros(int(sizes.sum()) + len(words), np.int64)  # each document is followed by a separator
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        for start, codes in zip(starts, words, strict=True):
            text[start : start + len(codes)] = codes
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (text > 0).astype(np.int8), [0]])))
        runs = edges.reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] >= self.shortest]
        none = np.empty(0, np.int64)
        if not len(runs) or not len(self.sizes):
            return none, none, none
        lengths = runs[:, 1] - runs[:, 0] + 1  # a run and its separator
        begins = np.concatenate([[0], np.cumsum(lengths)])
        places = np.repeat(runs[:, 0] - begins[:-1], lengths) + np.arange(begins[-1])
        index = FMIndex(text[places])
        low, high = index.search(self.symbols, self.sizes)
        counts = high - low
        phrase = np.repeat(np.arange(len(counts)), counts)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(counts.sum())
        at = places[index.locate(rows)]
        document = np.searchsorted(starts, at, side="right") - 1
        return document, at - starts[document], phrase


def _shards(batches: Iterable[pa.RecordBatch], codes: dict[bytes, int]) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Row batches with their documents' word codes, up to ``SHARD_WORDS`` at a time."""
    held, words, size = [], [], 0
    for batch in slices(batches, 64):
        held.append(batch)
        for text in batch.column("_text").to_pylist():
            found = WORD.findall((text or "").encode().lower())
            words.append(np.fromiter(map(codes.get, found, repeat(0)), np.int32, len(found)))
            size += len(found)
        if size >= SHARD_WORDS:
            yield held, words
            held, words, size = [], [], 0
    if held:
        yield held, words


def _char_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of hit words as code points of the text."""
    data = text.encode()
    places = [m.span() for m in WORD.finditer(data.lower())]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).reshape(-1, 2)
    chars = lambda upto: len(data[:upto].decode())
    return [{"start": chars(places[a][0]), "end": chars(places[b - 1][1])} for a, b in edges]


def find_phrases(df: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``n_hit``, ``hit_spans`` (code points, merged) and ``hit_items`` (distinct ids as strings, sorted).

    The benchmark goes to the tasks in passes of ``MAX_PHRASE_WORDS`` words at most; documents are not shuffled.
    """
    if clash := {"n_words", "n_hit", "hit_spans", "hit_items"} & set(df.columns):
        df = df.drop(*clash)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    volume = items.select(F.sum(F.length("text"))).first()[0] or 0
    passes = 1 + volume * window // 4 // MAX_PHRASE_WORDS
    out = None
    for part in range(passes):
        block = items if passes == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == part)
        phrases = Phrases(((r["item"], r["text"]) for r in block.toLocalIterator()), window)
        out = _one_pass(df if out is None else out, phrases, text_col, first=out is None)
    return out


def _one_pass(df: DataFrame, phrases: Phrases, text_col: str, first: bool) -> DataFrame:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    own = [pa.field("n_words", pa.int64()), pa.field("n_hit", pa.int64()), pa.field("hit_spans", pa.list_(span)), pa.field("hit_items", pa.list_(pa.string())), pa.field("_hit", pa.list_(pa.int32()))]
    columns = [c for c in df.columns if c not in {"n_words", "n_hit", "hit_spans", "hit_items"}]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in columns)
    shared = df.sparkSession.sparkContext.broadcast(phrases)  # bounded by MAX_PHRASE_WORDS

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for held, words in _shards(batches, known.codes):
            document, start, phrase = known.occurrences(words)
            order = np.argsort(document, kind="stable")
            bounds = np.searchsorted(document[order], np.arange(len(words) + 1))
            done = 0
            for batch in held:
                made: dict[str, list] = {f.name: [] for f in own}
                before = batch.column("hit_items").to_pylist() if not first else None
                spans = batch.column("hit_spans").to_pylist() if not first else None
                for row in range(batch.num_rows):
                    mine = order[bounds[done] : bounds[done + 1]]
                    size, found, covered, items = len(words[done]), 0, [], set(before[row]) if before else set()
                    if len(mine):
                        depth = np.zeros(size + 1, np.int64)
                        np.add.at(depth, start[mine], 1)
                        np.add.at(depth, start[mine] + known.sizes[phrase[mine]], -1)
                        hit = np.cumsum(depth)[:size] > 0
                        covered = _char_spans(batch.column("_text")[row].as_py(), hit)
                        items.update(i for p in set(phrase[mine].tolist()) for i in known.items[p])
                        found = int(hit.sum())
                    if spans and spans[row]:
                        covered, found = _joined(batch.column("_text")[row].as_py(), covered + spans[row])
                    for name, value in (("n_words", size), ("n_hit", found), ("hit_spans", covered), ("hit_items", sorted(items))):
                        made[name].append(value)
                    done += 1
                keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name in columns]
                yield pa.RecordBatch.from_arrays([*keep, *(pa.array(made[f.name], f.type) for f in own[:4])], [*columns, *(f.name for f in own[:4])])

    given = df.withColumn("_text", F.col(text_col).cast("string"))
    return given.mapInArrow(search, f"{kinds}, n_words bigint, n_hit bigint, hit_spans array<struct<start: bigint, end: bigint>>, hit_items array<string>")


def _joined(text: str, spans: list[dict[str, int]]) -> tuple[list[dict[str, int]], int]:
    """Spans of several passes as maximal runs of hit words, and the number of these words."""
    data = text.encode()
    words = [(len(data[: m.start()].decode()), len(data[: m.end()].decode())) for m in WORD.finditer(data.lower())]
    hit = np.array([any(s["start"] <= a and b <= s["end"] for s in spans) for a, b in words], bool)
    return _char_spans(text, hit), int(hit.sum())


def without_phrases(df: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", **names: str) -> DataFrame:
    """``df`` with the removal spans taken out of ``text_col``; rows without a hit, and all other columns of any name, stay as they are."""
    others = [c for c in df.columns if c != text_col]
    packed = df.select(F.struct(F.lit(0).alias("_"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(others))).alias("row"), F.col(text_col).cast("string").alias("given"))
    found = find_phrases(packed, benchmark, window, "given", **names)
    start = F.concat(F.array(F.lit(0).cast("long")), F.transform("hit_spans", lambda s: s["end"]))
    end = F.concat(F.transform("hit_spans", lambda s: s["start"]), F.array(F.length("given").cast("long")))
    kept = F.transform(F.arrays_zip(start.alias("a"), end.alias("b")), lambda s: F.substring(F.col("given"), (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")))
    text = F.when(F.col("n_hit") > 0, F.array_join(kept, "")).otherwise(F.col("given"))
    return found.select(*(text.alias(c) if c == text_col else F.col(f"row.c{others.index(c)}").alias(c) for c in df.columns))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 10-word passage of a benchmark item, and these items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_phrases(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
