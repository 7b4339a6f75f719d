"""Toxicity scores by non-negative positive-unlabelled learning.

A linear model over hashed words and word beginnings is trained from confirmed toxic texts and unlabelled texts. With the class prior p the risk is
p R+(positives) + max(0, R-(unlabelled) - p R-(positives)): the second term is the risk on negatives, corrected for the toxic
texts hidden among the unlabelled ones and kept from falling under zero. The learner is numpy with full-batch Adam steps.

Training reads at most ``max_positive`` and ``max_unlabelled`` rows, drawn by a hash of the id; the prior is the share of toxic
labels over all training labels. Scoring reads every whole text.

Cases: a null or empty text has no words and gets the model's base score. Rows without a label, or with a null label, are unlabelled. Of
several labels of one id the highest holds. Without any toxic label every score is the prior, 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleset.llm.common import slices, table, written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS = 1 << 18
#: Words a worker remembers with their weights.
CACHE = 150_000
#: Production bounds of the training sample, and which features get a weight: the rarest (texts of the sample), and the least
#: standard score by which the shares of toxic and of unlabelled texts that hold it differ.
MAX_POSITIVE, MAX_UNLABELLED, MIN_TEXTS, MIN_SCORE = 4000, 16000, 10, 4.0
#: Lengths in bytes of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6)


@dataclass
class PUModel:
    """Weights of hashed words, and a base value."""

    weights: np.ndarray
    base: float

    def score(self, value: float) -> float:
        """Chance of the label, for a sum of weights."""
        return float(1 / (1 + np.exp(-np.clip(value + self.base, -50, 50))))


def words(text: str | None) -> set[bytes]:
    """Distinct words of a text, A-Z lower-cased."""
    return set(WORD.findall((text or "").encode().lower()))


def features(word: bytes) -> list[int]:
    """Buckets of a word and its beginnings."""
    return [zlib.crc32(word) % BUCKETS, *(zlib.crc32(b"^" + word[:n]) % BUCKETS for n in BEGINNINGS if len(word) > n)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], kept: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 2e-5) -> PUModel:
    """Minimises the non-negative risk (logistic loss) over texts given as arrays of places in ``kept`` buckets, repeats counting."""
    if not positive or not 0 < prior < 1:
        return PUModel(np.zeros(BUCKETS, np.float32), -50.0 if prior <= 0 or not positive else 0.0)
    texts = positive + unlabelled
    sizes = np.array([len(t) for t in texts])
    flat = np.concatenate(texts).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    n_pos, n = len(positive), len(texts)
    n_unl = max(1, n - n_pos)
    theta, m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        value = np.bincount(owner, theta[flat], minlength=n) + theta[-1]
        p, loss_as_negative = _sigmoid(value), np.logaddexp(0, value)
        negative = loss_as_negative[n_pos:].mean() - prior * loss_as_negative[:n_pos].mean() if n > n_pos else 0.0
        slope = np.zeros(n)
        if negative >= 0:
            slope[:n_pos] = prior * (p[:n_pos] - 1) / n_pos - prior * p[:n_pos] / n_pos
            slope[n_pos:] = p[n_pos:] / n_unl
        else:  # the corrected risk fell under zero: step back on that term alone
            slope[:n_pos] = prior * p[:n_pos] / n_pos
            slope[n_pos:] = -p[n_pos:] / n_unl
        gradient = np.append(np.bincount(flat, slope[owner], minlength=len(kept)), slope.sum())
        gradient[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[kept] = theta[:-1]
    return PUModel(weights, float(theta[-1]))


def _telling(found: DataFrame, min_texts: int, min_score: float) -> np.ndarray:
    """Buckets that enough texts of the sample hold, and that toxic and unlabelled texts hold to different shares."""
    rows = {r["positive"]: r["n"] for r in found.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_unl = max(1, rows.get(True, 0)), max(1, rows.get(False, 0))
    held = found.select("positive", F.explode(F.array_distinct("buckets")).alias("bucket")).groupBy("bucket").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    rate, share = F.col("n") / (n_pos + n_unl), F.abs(F.col("p") / n_pos - (F.col("n") - F.col("p")) / n_unl)
    kept = held.where((F.col("n") >= min_texts) & (share >= min_score * (F.sqrt(rate * (1 - rate) * (1 / n_pos + 1 / n_unl)) + 1e-9)))
    return np.sort(kept.select("bucket").toArrow().column("bucket").to_numpy().astype(np.int64))  # BUCKETS at most


def _buckets(df: DataFrame) -> DataFrame:
    """``positive`` and the word buckets of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[i for w in words(t) for i in features(w)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["positive", "buckets"])

    return df.select("positive", "_text").mapInArrow(run, "positive boolean, buckets array<int>")


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, min_texts: int = MIN_TEXTS, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> PUModel:
    """Trains on the rows given; leave rows out of both tables to hold them out."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where("_label is not null and _id is not null").groupBy("_id").agg(F.max("_label").alias("_label"))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("_label") > 0).cast("long")).alias("toxic")).first()
    prior = (counts["toxic"] or 0) / counts["n"] if counts["n"] else 0.0
    draw = F.xxhash64(F.col("_id").cast("string"))
    toxic = known.where("_label > 0").select("_id")
    positive = toxic.orderBy(draw, "_id").limit(max_positive).withColumn("positive", F.lit(True))
    # The known toxic texts are left out of the unlabelled ones, so the prior of these is the share of toxic ones in what is left.
    ids = docs.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    others = docs.select(F.col(id_col).alias("_id")).where("_id is not null").join(toxic, "_id", "left_anti")
    left = ids.join(known, "_id", "left").agg(F.sum(F.col("_label").isNull().cast("long")).alias("unknown"), F.sum((F.coalesce("_label", F.lit(0)) <= 0).cast("long")).alias("rest")).first()
    prior = prior * (left["unknown"] or 0) / left["rest"] if left["rest"] else 0.0
    unlabelled = others.orderBy(draw, "_id").limit(max_unlabelled).withColumn("positive", F.lit(False))
    drawn = positive.unionByName(unlabelled)  # at most max_positive + max_unlabelled ids, so it is broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(drawn), "_id")
    found = written(_buckets(texts), "toxicity-sample")
    kept = _telling(found, min_texts, min_score)

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for row in batch.column(1):
                buckets = np.asarray(row.values)
                at = np.searchsorted(kept, buckets)
                out.append(at[(at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == buckets)] if len(kept) else at[:0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["positive", "places"])

    got = found.mapInArrow(places, "positive boolean, places array<int>").toArrow()
    marks, rows = got.column("positive").to_pylist(), [np.asarray(got.column("places")[i].values) for i in range(got.num_rows)]
    return train([r for r, is_toxic in zip(rows, marks, strict=True) if is_toxic], [r for r, is_toxic in zip(rows, marks, strict=True) if not is_toxic], kept, prior)


def score(df: DataFrame, model: PUModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of every whole text; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, cache = shared.value, {}
        weights = model.weights
        for series in texts:
            values = []
            for text in series:
                total = 0.0
                for word in words(text):
                    weight = cache.get(word)
                    if weight is None:
                        if len(cache) >= CACHE:
                            cache.clear()
                        weight = cache[word] = float(weights[features(word)].sum())
                    total += weight
                values.append(model.score(total))
            yield pd.Series(values)

    return df.withColumn(out, run(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score``, by a model of the rows that are not held out."""
    return score(docs, fit(docs.where(~held_out()), labels.where(~held_out())))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored_documents(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
