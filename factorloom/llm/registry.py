"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html, langid, leaks, merkle, neardup, packing, quality, rans, secrets, spans

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = [
        rans.op1_rans_token_ids,
        html.op2_subsequence_main_text,
        merkle.op3_merkle_fingerprints,
        quality.op4_crf_quality,
        packing.op5_nnls_packing,
        spans.op6_sentence_spans,
        secrets.op7_secret_ownership,
        leaks.op8_benchmark_leaks,
        langid.op9_compression_langid,
        neardup.op10_odd_sketch_near_duplicates,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Tokenizers, models, page parsing and hashes that DuckDB lacks leave none that SQL can express on whole tables."""
    return {}
