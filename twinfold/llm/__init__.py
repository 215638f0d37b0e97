"""Operators for preparing training data. Nothing else in the package imports this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .bpe_codec import op2_bpe_codec
    from .conversation_repair import op13_conversation_repair
    from .fingerprints import op1_fingerprints
    from .language import op10_language
    from .near_copies import op7_near_copies
    from .packing import op5_packing
    from .quality import op9_quality
    from .simhash import op12_simhash
    from .source_divergence import op11_source_divergence
    from .surrogates import op8_surrogates
    from .token_counts import op4_token_counts
    from .token_files import op3_token_files
    from .url_filter import op6_url_filter

    found = (op1_fingerprints, op2_bpe_codec, op3_token_files, op4_token_counts, op5_packing, op6_url_filter, op7_near_copies, op8_surrogates, op9_quality, op10_language, op11_source_divergence, op12_simhash, op13_conversation_repair)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .near_copies import OP7_SQL
    from .source_divergence import OP11_SQL

    return {"op7_near_copies": OP7_SQL, "op11_source_divergence": OP11_SQL}
