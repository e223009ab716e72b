"""Registered queries of the subpackage and, where SQL can express one, its oracle."""

from __future__ import annotations

import corpus_pipeline

from . import ann, chat, decontaminate, pivots, warc
from .align import op13_tokenizer_alignment
from .common import Query
from .decontaminate import op8_benchmark_decontamination
from .html import op2_html_extraction
from .langid import op9_language_id
from .linededup import op6_line_dedup
from .mix import op4_mix_sources
from .pivots import op11_embedding_near_dedup
from .resample import op12_importance_resampling
from .simhash import op10_simhash_near_dedup
from .toxicity import op5_toxicity

QUERIES: dict[str, Query] = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_html_extraction": op2_html_extraction,
    "op3_warc": warc.op3_warc,
    "op4_mix_sources": op4_mix_sources,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_nearest_neighbours": ann.op7_nearest_neighbours,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_language_id": op9_language_id,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_embedding_near_dedup": op11_embedding_near_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {"op1_chat_formatting": chat.ORACLE, "op3_warc": warc.ORACLE, "op7_nearest_neighbours": ann.ORACLE,
                          "op8_benchmark_decontamination": decontaminate.ORACLE,
                          "op11_embedding_near_dedup": pivots.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
