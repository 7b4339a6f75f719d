"""Removal of byte strings that occur more than once, by bucket-pointer refinement over sampled suffixes.

A bucket holds the suffixes that agree in their first q bytes and is known by a 64-bit identifier. Identifiers of longer
prefixes come from identifiers at later offsets: the bucket of 2q bytes at p is named by the buckets of q bytes at p and
p + q, and each refined name is used again for the next one. Buckets of one suffix need no refinement and drop out.

Only sampled suffixes are sorted into buckets first: of every run of 400-byte strings, those starting at the smallest
100-byte identifier (ties: all). The choice depends on the bytes alone, so equal 400-byte strings hold a sampled suffix at the same
offset. Buckets with two suffixes or more are refined by the identifiers around them (all 400-byte strings through the sample
at once). Where that leaves a suffix alone in its refined bucket, as at the ends of a copied passage, the same is done for runs of starts, and for what
these leave open every start is named by its own 400-byte identifier.

Cases: a null text is an empty text. Texts under ``length`` bytes lose nothing. Repeated rows are copies of each other. A null
id is a value like any other. Very long texts are sampled block by block; the refinement of a start reads only its surroundings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xxhash import xxh3_64_intdigest

from rippleset.llm.common import slices, table, written

#: Bytes of a text that are sampled at once.
BLOCK = 1 << 21
#: Starts that are refined together, and texts up to which what was found for them is broadcast.
RUN, FEW = 38, 300_000
_KEY = ["_id", "_text_key"]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ALL = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def bucket_names(data: np.ndarray, length: int) -> np.ndarray:
    """For each start, the identifier of the bucket of its first ``length`` bytes, refined from later offsets."""
    names, have = data.astype(np.uint64) + np.uint64(1), 1
    if len(data) < length:
        return np.empty(0, np.uint64)
    while have < length:
        step = min(have, length - have)
        names = _mix(names[:-step] * np.uint64(0xD6E8FEB86659FD93) + names[step:])
        have += step
    return names


def _sliding(x: np.ndarray, width: int, of: np.ufunc, fill: int) -> np.ndarray:
    """``of`` over every run of ``width`` values."""
    if width == 1:
        return x
    rows = -(-len(x) // width)
    padded = np.full(rows * width, fill, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    ahead = of.accumulate(grid, axis=1).ravel()
    back = of.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return of(back[:n], ahead[width - 1 : width - 1 + n])


def sampled(data: np.ndarray, length: int, gram: int, at: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the sampled suffixes of a piece at ``at`` of a text of ``total`` bytes, their buckets and refined buckets."""
    names = bucket_names(data, gram)
    width = length - gram + 1
    if len(names) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    least = _sliding(names, width, np.minimum, np.iinfo(np.uint64).max)
    edge = np.zeros(width - 1, np.uint64)
    starts = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum, 0) == names)
    low = np.maximum(starts + at - (length - gram), 0) - at
    high = np.minimum(starts + at + length, total) - at
    refined = (starts - low).astype(np.uint64) * np.uint64(1 << 20) + (high - starts).astype(np.uint64)
    for k in range(0, 2 * length - gram, gram):  # identifiers at all offsets around the sample, clipped to the text
        offset = np.clip(np.clip(low + k, 0, high - gram), 0, len(names) - 1)  # samples in a block's margins belong to other blocks
        refined = _mix(refined * np.uint64(0xD6E8FEB86659FD93) + names[offset])
    return starts, names[starts], refined


def _samples(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, total = np.frombuffer(text, np.uint8), len(text)
    if total <= 2 * BLOCK:
        return sampled(data, length, gram, 0, total)
    found = []
    for at in range(0, total, BLOCK):
        low, high = max(0, at - 3 * length), min(total, at + BLOCK + 3 * length)
        starts, *names = sampled(data[low:high], length, gram, low, total)
        own = (starts + low >= at) & (starts + low < at + BLOCK)
        found.append((starts[own] + low, names[0][own], names[1][own]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _beside(docs: DataFrame, found: DataFrame, how: str, few: int) -> DataFrame:
    """Texts with what was found for them; a null id meets a null id.

    What was found is written first; up to ``few`` rows of it are broadcast, so that the texts stay where they are, more are shuffled.
    """
    found = written(found.withColumnsRenamed({name: f"_of{name}" for name in _KEY}), "suffix-found")
    found = F.broadcast(found) if found.count() <= few else found
    return docs.join(found, F.col("_id").eqNullSafe(F.col("_of_id")) & (F.col("_text_key") == F.col("_of_text_key")), how)


def _refined(rows: DataFrame, by: list[str], place: list[str]) -> DataFrame:
    """Refined buckets inside shared buckets: members ``n``, ``one`` of them, and how many of the bucket are ``alone`` in theirs."""
    groups = rows.groupBy(*by, "refined").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_KEY, *place)).alias("one"))
    buckets = groups.groupBy(*by).agg(F.sum("n").alias("total"), F.sum((F.col("n") == 1).cast("long")).alias("alone")).where("total > 1")
    return written(groups.join(buckets, by), "suffix-buckets")


def _left(groups: DataFrame) -> DataFrame:
    """Members alone in their refined bucket but not in the bucket, and one member of each refined bucket beside such."""
    return groups.where("n = 1 or alone > 0").select("one.*")


def repeated_spans(df: DataFrame, length: int = 400, gram: int = 100, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """``_id``, ``_text_key`` and ``spans array<struct<start,end>>`` (bytes, merged) of texts that hold repeated strings."""
    if not gram <= length < 1 << 19:
        raise ValueError("gram must not exceed length")
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    docs = docs.withColumn("_text_key", F.xxhash64("_text")).select(*_KEY, "_text")
    id_type = docs.schema["_id"].dataType.simpleString()
    key_type = f"_id {id_type}, _text_key bigint"

    def sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, found, sizes = [], [], []
            for row, text in enumerate(batch.column(2)):
                text = text.as_py().encode()
                if len(text) >= length:
                    found.append(_samples(text, length, gram))
                    rows.append(np.full(len(found[-1][0]), row, np.int32))
                    sizes.append(np.full(len(found[-1][0]), len(text), np.int64))
            if rows:
                starts, names, refined = (np.concatenate(x) for x in zip(*found, strict=True))
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(starts.astype(np.int64)), pa.array(np.concatenate(sizes)), pa.array(names.view(np.int64)), pa.array(refined.view(np.int64))], [*_KEY, "at", "size", "bucket", "refined"])

    samples = written(docs.mapInArrow(sample, f"{key_type}, at bigint, size bigint, bucket bigint, refined bigint"), "suffix-samples")
    groups = _refined(samples, ["bucket"], ["at"])

    # Refined buckets of two and more: all strings through these samples are repeated.
    whole = samples.join(groups.where("n > 1").select("bucket", "refined"), ["bucket", "refined"])
    whole = whole.select(*_KEY, F.greatest(F.col("at") - (length - gram), F.lit(0)).alias("start"), F.least(F.col("at") + length, F.col("size")).alias("end"))

    # The others of a shared bucket, and one member of each refined bucket beside them, are refined in runs of starts: by the
    # bytes common to a run's strings, and by all bytes of the run.
    rest = _left(groups).groupBy(*_KEY).agg(F.collect_set("at").alias("ats"))
    near = written(_beside(docs, rest, "inner", few).select(*_KEY, "_text", "ats"), "suffix-texts")

    def name_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, parts = xxh3_64_intdigest, [(k, min(k + RUN - 1, length - gram)) for k in range(0, length - gram + 1, RUN)]
        for batch in slices(batches, 64):
            rows, made = [], []
            for row, (text, ats) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                text, before = text.encode(), len(made)
                top = len(text) - length
                for at in ats:
                    bucket = digest(text[at : at + gram])
                    for k, end in parts:
                        low = first = at - end
                        high = last = at - k
                        if low < 0:
                            low = 0
                        if high > top:
                            high = top
                        if low <= high:
                            core = digest(text[last : first + length], (bucket + k) & _ALL)
                            made.append((low, high, core, digest(text[low : high + length], (core + (at - low) * RUN + high - low) & _ALL)))
                rows.append(np.full(len(made) - before, row, np.int32))
            if made:
                take = pa.array(np.concatenate(rows))
                low, high, core, refined = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(np.array(core, np.uint64).view(np.int64)), pa.array(np.array(refined, np.uint64).view(np.int64))], [*_KEY, "low", "high", "core", "refined"])

    runs = written(near.mapInArrow(name_runs, f"{key_type}, low bigint, high bigint, core bigint, refined bigint"), "suffix-runs")
    run_groups = _refined(runs, ["core"], ["low", "high"])
    whole_runs = runs.join(run_groups.where("n > 1").select("core", "refined"), ["core", "refined"]).select(*_KEY, F.col("low").alias("start"), (F.col("high") + length).alias("end"))

    # What a run leaves open is named start by start.
    open_runs = _left(run_groups).groupBy(*_KEY).agg(F.collect_set(F.struct("low", "high")).alias("runs"))

    def name_starts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows, starts, found = [], [], []
            for row in range(batch.num_rows):
                text, high = np.frombuffer(batch.column(2)[row].as_py().encode(), np.uint8), -1
                for run in sorted((r["low"], r["high"]) for r in batch.column(3)[row].as_py()):
                    low, high = max(high + 1, run[0]), max(high, run[1])  # no start is named twice
                    if low <= high:
                        found.append(bucket_names(text[low : high + length], length))
                        starts.append(np.arange(low, high + 1))
                        rows.append(np.full(high + 1 - low, row, np.int32))
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(starts).astype(np.int64)), pa.array(np.concatenate(found).view(np.int64))], [*_KEY, "start", "name"])

    starts = _beside(near.select(*_KEY, "_text"), open_runs, "inner", few).select(*_KEY, "_text", "runs").mapInArrow(name_starts, f"{key_type}, start bigint, name bigint")
    starts = written(starts, "suffix-starts")
    shared = starts.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    single = starts.join(shared, "name").select(*_KEY, "start", (F.col("start") + length).alias("end"))
    every = whole.unionByName(whole_runs).unionByName(single).groupBy(*_KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for spans in batch.column(2).to_pylist():
                merged: list[list[int]] = []
                for start, end in sorted((s["start"], s["end"]) for s in spans):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                out.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _SPANS)], [*_KEY, "spans"])

    return every.mapInArrow(merge, f"{key_type}, spans array<struct<start: bigint, end: bigint>>")


def remove_repeats(df: DataFrame, length: int = 400, gram: int = 100, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """``id_col``, ``n_bytes``, ``spans`` (maximal removed runs, in bytes) and ``kept`` (the other bytes) of every row."""
    spans = repeated_spans(df, length, gram, id_col, text_col, few)
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumn("_text_key", F.xxhash64("_text"))
    joined = _beside(docs, spans, "left", few).select("_id", "_text", "spans")
    id_type = docs.schema["_id"].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, runs, kept = [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                text, merged = text.as_py().encode(), [(s["start"], s["end"]) for s in found.as_py() or []]
                edges = [0, *(x for run in merged for x in run), len(text)]
                sizes.append(len(text))
                runs.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, _SPANS), pa.array(kept, pa.binary())], ["_id", "n_bytes", "spans", "kept"])

    out = joined.mapInArrow(cut, f"_id {id_type}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return out.withColumnRenamed("_id", id_col)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of every document without its 400-byte strings that start anywhere else too."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (removed > 0).alias("removed"))
