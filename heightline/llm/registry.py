"""Queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

import functools

from heightline.llm import byte_bpe, collocation, jaccard_join, matroska, mixing, packing, permutation_index, quality, sharding, substring_dedup, toxicity, url_filter, vector_codes
from heightline.staging import document_batches


def _in_batches(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        document_batches(spark)
        return query(spark, sf_dir)

    return run


def queries():
    found = {
        "op1_packing": packing.op1_packing,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_sharding": sharding.op3_sharding,
        "op4_quality_classifier": quality.op4_quality_classifier,
        "op5_permutation_index": permutation_index.op5_permutation_index,
        "op6_media_columns": matroska.op6_media_columns,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_byte_bpe": byte_bpe.op8_byte_bpe,
        "op9_url_filters": url_filter.op9_url_filters,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_source_mixing": mixing.op12_source_mixing,
        "op13_collocations": collocation.op13_collocations,
    }
    return {name: _in_batches(query) for name, query in found.items()}


def oracle_sql():
    return {
        "op7_substring_dedup": substring_dedup.ORACLE,
        "op9_url_filters": url_filter.ORACLE,
        "op10_jaccard_join": jaccard_join.ORACLE,
        "op11_vector_codes": vector_codes.ORACLE,
        "op12_source_mixing": mixing.ORACLE,
        "op13_collocations": collocation.ORACLE,
    }
