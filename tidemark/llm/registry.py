"""The queries of this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .decontaminate import op5_decontaminate
from .html_extract import op8_html_extract
from .jaccard_join import op10_jaccard_join
from .language_id import op3_language_id
from .media_chunks import op7_media_chunks
from .sentence_pieces import op1_sentence_pieces
from .substring_dedup import op9_substring_dedup
from .suffix_dedup import op2_suffix_dedup
from .token_store import op6_token_store
from .toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentence_pieces": op1_sentence_pieces,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_store": op6_token_store,
    "op7_media_chunks": op7_media_chunks,
    "op8_html_extract": op8_html_extract,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_jaccard_join": op10_jaccard_join,
}

SQL: dict[str, str] = oracles.SQL
