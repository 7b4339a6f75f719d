"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of ``documents``; the
last one returns the tokens. ``run`` writes each stage's result to the shared folder and reads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleset.llm.common import table, written
from rippleset.llm.decontaminate import without_phrases
from rippleset.llm.ngram_join import one_of_each
from rippleset.llm.piece_tokens import encode_decode
from rippleset.llm.secret_scan import redact
from rippleset.llm.toxicity import fit, held_out, score

REJECTED_FROM = 0.7


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` of changed texts, where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score under ``REJECTED_FROM``; labels are learnt from rows that are not held out."""
    model = fit(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    mark = "_score" + "_" * max((len(c) for c in docs.columns), default=0)  # no column of the documents
    return score(docs, model, out=mark).where(F.col(mark) < REJECTED_FROM).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each class of near copies."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes benchmark passages out of the texts."""
    return _measured(without_phrases(docs, table(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark."""
    return _measured(redact(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the texts, with a digest of what they decode to."""
    import public_tokenizers

    out = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: The learnt and the iterative stages have no SQL form; tests compare what they are made of with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
