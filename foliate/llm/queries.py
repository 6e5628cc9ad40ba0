"""Queries of this subpackage and, where SQL can express them over whole tables, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, fim, lexical, quality, secret_scan
from .bpe import op10_bpe
from .chat import op5_chat_formatting
from .fim import op12_fill_in_middle
from .lexical import op11_ranked_search
from .media import op8_media_columns
from .minhash import op1_minhash_near_dedup
from .packing import op2_packing
from .quality import op3_quality_rules
from .rans import op13_token_output
from .secret_scan import op6_secret_scans
from .sharding import op7_sharding
from .toxicity import op4_toxicity
from .url_filter import op9_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_minhash_near_dedup,
        op2_packing,
        op3_quality_rules,
        op4_toxicity,
        op5_chat_formatting,
        op6_secret_scans,
        op7_sharding,
        op8_media_columns,
        op9_url_filters,
        op10_bpe,
        op11_ranked_search,
        op12_fill_in_middle,
        op13_token_output,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        op3_quality_rules.__name__: quality.SQL,
        op5_chat_formatting.__name__: chat.SQL,
        op6_secret_scans.__name__: secret_scan.SQL,
        op11_ranked_search.__name__: lexical.SQL,
        op12_fill_in_middle.__name__: fim.SQL,
    }
