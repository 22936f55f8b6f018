"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_language_id, op2_substring, op3_cover_tree, op4_licenses, op5_toxicity, op6_pieces, op7_warc, op8_mixing, op9_jaccard, op10_hnsw, op11_variants, op12_collocations, op13_suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id.query,
    "op2_substring": op2_substring.query,
    "op3_cover_tree": op3_cover_tree.query,
    "op4_licenses": op4_licenses.query,
    "op5_toxicity": op5_toxicity.query,
    "op6_pieces": op6_pieces.query,
    "op7_warc": op7_warc.query,
    "op8_mixing": op8_mixing.query,
    "op9_jaccard": op9_jaccard.query,
    "op10_hnsw": op10_hnsw.query,
    "op11_variants": op11_variants.query,
    "op12_collocations": op12_collocations.query,
    "op13_suffix_dedup": op13_suffix_dedup.query,
}
ORACLES: dict[str, str] = {"op2_substring": op2_substring.ORACLE, "op3_cover_tree": op3_cover_tree.ORACLE, "op7_warc": op7_warc.ORACLE, "op8_mixing": op8_mixing.ORACLE, "op9_jaccard": op9_jaccard.ORACLE, "op12_collocations": op12_collocations.ORACLE, "op13_suffix_dedup": op13_suffix_dedup.ORACLE}
