"""Secret scans with DataFrame expressions only.

Three patterns find assignments, access keys and hexadecimal runs. Beside them two character Markov models, of random strings and of
ordinary identifiers, give every other long token the log of the likelihood ratio of its character transitions; tokens above a bound
are secrets too. Both models are counted from labelled samples: the values the patterns found are random strings, other words are
ordinary. Counting and scoring are Spark expressions; what the driver sees is one number for each pair of characters.

Positions are code points, end exclusive. Cases: a null or empty text has no spans. Without training rows both models are equal and
no token is added. Overlapping patterns are all reported, tokens that overlap one are not. Repeated rows are treated alike.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleset.llm.common import table, written

# --- Fixed values: the patterns' forms and their least lengths ---
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # of runs AKIA[A-Z0-9]+, those of 18 characters and more
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12
# ---
KINDS = ("assign", "access", "hex", "random")
#: Tokens that the models judge, the characters they know (any other is the last), and the words that train the ordinary model.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
WORDS = r"[A-Za-z][A-Za-z_-]{5,}"
#: Bounds of the training sample (texts of each label), and the least log ratio of a token: in sum and for each transition.
SAMPLE_TEXTS, LEAST_SUM, LEAST_MEAN = 2000, 12.0, 0.6

_SPAN = "array<struct<kind: int, start: int, end: int>>"


def _places(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """Spans of a pattern's matches; positions follow from the lengths of matches and of what lies between them."""
    none = F.lit(None).cast(_SPAN)
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("b"), (keep if keep is not None else F.transform(found, lambda m: F.lit(True))).alias("k"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("out"))

    def add(acc: Column, part: Column) -> Column:
        begin = acc["at"] + F.length(part["b"])
        end = begin + F.length(part["m"])
        span = F.array(F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(part["k"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(parts, start, add, lambda acc: acc["out"])
    return F.coalesce(F.when(text.rlike(pattern), spans).otherwise(none), F.expr(f"cast(array() as {_SPAN})"))


def base_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``_text`` and the patterns' spans in ``_base``, by start and kind."""
    text = F.col("_text")
    kept = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda value: F.length(value) >= ASSIGN_VALUE)
    found = F.concat(_places(text, ASSIGN, 0, kept), _places(text, ACCESS, 1), _places(text, HEX, 2))
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return df.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn("_base", F.transform(order, lambda s: F.struct(s["kind"], s["start"], s["end"])))


def _index(character: Column) -> Column:
    return F.when(F.instr(F.lit(ALPHABET), character) > 0, F.instr(F.lit(ALPHABET), character) - 1).otherwise(len(ALPHABET))


def _transitions(strings: DataFrame) -> DataFrame:
    """Counts of adjacent character pairs of a column ``s``."""
    pairs = strings.where(F.length("s") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring(F.col("s"), i, F.lit(2)))).alias("pair"))
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def log_ratios(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """log P(next | character) of random strings less that of ordinary ones, for each pair of the alphabet (add-one counts)."""
    size = len(ALPHABET) + 1
    place = {c: i for i, c in enumerate(ALPHABET)}
    logs = []
    for strings in (random, ordinary):
        counts = [[1.0] * size for _ in range(size)]
        known = F.when(F.instr(F.lit(ALPHABET), F.substring("pair", 1, 1)) > 0, F.substring("pair", 1, 1)).otherwise(" ")
        after = F.when(F.instr(F.lit(ALPHABET), F.substring("pair", 2, 1)) > 0, F.substring("pair", 2, 1)).otherwise(" ")
        for r in _transitions(strings).groupBy(known.alias("a"), after.alias("b")).agg(F.sum("n").alias("n")).collect():  # alphabet squared
            counts[place.get(r["a"], size - 1)][place.get(r["b"], size - 1)] += r["n"]
        logs.append([[math.log(n / sum(row)) for n in row] for row in counts])
    return [a - b for first, second in zip(*logs, strict=True) for a, b in zip(first, second, strict=True)]


def train(df: DataFrame, text_col: str = "text", sample_texts: int = SAMPLE_TEXTS) -> list[float]:
    """Transition log ratios from a bounded sample of texts with, and of texts without, pattern matches.

    Texts are drawn by their hash: a bound from the number of texts lets about twice the sample pass, so tasks give out few of them.
    """
    texts = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    draws = written(base_spans(texts, "_text").select(F.xxhash64("_text").alias("draw"), (F.size("_base") > 0).alias("marked")), "secret-draws")
    counts = {r["marked"]: r["n"] for r in draws.groupBy("marked").agg(F.count(F.lit(1)).alias("n")).collect()}

    def drawn(marked: bool) -> DataFrame:
        share = min(1.0, 2 * sample_texts / max(1, counts.get(marked, 0)))
        bound = min(2**63 - 1, -(2**63) + int(share * 2**64))
        ids = draws.where((F.col("marked") == marked) & (F.col("draw") <= bound)).select("draw").distinct().orderBy("draw").limit(sample_texts)
        chosen = texts.withColumn("draw", F.xxhash64("_text")).join(F.broadcast(ids), "draw", "left_semi").dropDuplicates(["draw"])
        return base_spans(chosen, "_text").where((F.size("_base") > 0) == marked)

    values = F.transform("_base", lambda s: F.substring(F.col("_text"), s["start"] + 1, s["end"] - s["start"]))
    random = drawn(True).select(F.explode(values).alias("v")).select(F.regexp_extract("v", r"([A-Za-z0-9+/_.=-]+)$", 1).alias("s"))
    ordinary = drawn(False).select(F.explode(F.regexp_extract_all("_text", F.lit(WORDS), F.lit(0))).alias("s"))
    return log_ratios(random, ordinary)


def _log_ratio(token: Column, weights: Column) -> Column:
    size = len(ALPHABET) + 1
    codes = F.transform(F.split(token, ""), _index)
    steps = F.sequence(F.lit(1), F.length(token) - 1)
    return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.element_at(weights, F.element_at(codes, i) * size + F.element_at(codes, i + 1) + 1))


def scan(df: DataFrame, text_col: str = "text", sample_texts: int = SAMPLE_TEXTS, least_sum: float = LEAST_SUM, least_mean: float = LEAST_MEAN) -> DataFrame:
    """``df`` with ``spans array<struct<kind,start,end>>`` (numbers of ``KINDS``), by start and kind; a column of that name is replaced.

    Columns ``_text`` and ``_base`` are used inside and must not be given; ``redact`` takes any.
    """
    found = base_spans(df, text_col)
    model = train(df, text_col, sample_texts)
    weights = F.from_json(F.lit(json.dumps([round(x, 4) for x in model])), "array<double>")
    tokens = _places(F.col("_text"), TOKEN, 3)

    def secret(s: Column) -> Column:
        total = _log_ratio(F.substring(F.col("_text"), s["start"] + 1, s["end"] - s["start"]), weights)
        apart = ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return apart & (total >= least_sum) & (total >= least_mean * (s["end"] - s["start"] - 1))

    every = F.array_sort(F.transform(F.concat("_base", F.filter(tokens, secret)), lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return found.withColumn("spans", F.transform(every, lambda s: F.struct(s["kind"], s["start"], s["end"]))).drop("_text", "_base")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", **params) -> DataFrame:
    """``df`` with each secret's text replaced by ``mark``; overlapping spans become one. All other columns, of any name, stay as they are."""
    others = [c for c in df.columns if c != text_col]
    packed = df.select(F.struct(F.lit(0).alias("_"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(others))).alias("row"), F.col(text_col).cast("string").alias("given"))
    found = scan(packed, "given", **params)
    text = F.col("given")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = (s["start"] >= acc["at"]) & ((s["start"] > acc["at"]) | (F.length(acc["out"]) == 0) | ~F.endswith(acc["out"], F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.when(fresh, F.concat(gap, F.lit(mark))).otherwise("")).alias("out"))

    clean = F.aggregate("spans", start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    cleaned = F.when(F.size("spans") > 0, clean).otherwise(text)
    return found.select(*(cleaned.alias(c) if c == text_col else F.col(f"row.c{others.index(c)}").alias(c) for c in df.columns))


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
