"""Registered queries of the training-data operators, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from rippleset.llm.chat_format import OP8_SQL, op8_chat_format
from rippleset.llm.decontaminate import op7_decontaminate
from rippleset.llm.html_blocks import op11_html_blocks
from rippleset.llm.license_scan import OP5_SQL, op5_license_scan
from rippleset.llm.ngram_join import op9_ngram_join
from rippleset.llm.piece_tokens import op3_sentencepiece
from rippleset.llm.rtree_negatives import OP13_SQL, op13_hard_negatives
from rippleset.llm.secret_scan import op10_secret_scan
from rippleset.llm.spelling_groups import op12_spelling_groups
from rippleset.llm.suffix_dedup import op1_suffix_dedup
from rippleset.llm.token_counts import op6_token_counts
from rippleset.llm.toxicity import op2_toxicity
from rippleset.llm.voronoi_topk import OP4_SQL, op4_voronoi_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_voronoi_topk": op4_voronoi_topk,
    "op5_license_scan": op5_license_scan,
    "op6_token_counts": op6_token_counts,
    "op7_decontaminate": op7_decontaminate,
    "op8_chat_format": op8_chat_format,
    "op9_ngram_join": op9_ngram_join,
    "op10_secret_scan": op10_secret_scan,
    "op11_html_blocks": op11_html_blocks,
    "op12_spelling_groups": op12_spelling_groups,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op4_voronoi_topk": OP4_SQL, "op5_license_scan": OP5_SQL, "op8_chat_format": OP8_SQL, "op13_hard_negatives": OP13_SQL}
