"""Queries of the training-data operators, one for each, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from medspan.llm import op1_language, op2_urls, op3_secrets, op4_mixing, op5_merkle, op6_quality, op7_tokens, op8_decontaminate, op9_pii, op10_simhash, op11_search, op12_centroids, op13_jaccard

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language.query,
    "op2_url_filter": op2_urls.query,
    "op3_secrets": op3_secrets.query,
    "op4_mixing": op4_mixing.query,
    "op5_merkle": op5_merkle.query,
    "op6_quality": op6_quality.query,
    "op7_tokens": op7_tokens.query,
    "op8_decontaminate": op8_decontaminate.query,
    "op9_pii": op9_pii.query,
    "op10_simhash": op10_simhash.query,
    "op11_search": op11_search.query,
    "op12_centroids": op12_centroids.query,
    "op13_jaccard": op13_jaccard.query,
}

#: DuckDB SQL where it can express an operator; trained models and stateful methods have none.
ORACLE_SQL: dict[str, str] = {
    "op4_mixing": op4_mixing.ORACLE_SQL,
    "op5_merkle": op5_merkle.ORACLE_SQL,
    "op11_search": op11_search.ORACLE_SQL,
    "op12_centroids": op12_centroids.ORACLE_SQL,
    "op13_jaccard": op13_jaccard.ORACLE_SQL,
}
