"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import archive, bwt, html, near, packing, pieces, quality, rlz, secrets, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": rlz.op1_substring_dedup,
    "op2_minhash_near_dedup": near.op2_minhash_near_dedup,
    "op3_packing": packing.op3_packing,
    "op4_suffix_array_dedup": bwt.op4_suffix_array_dedup,
    "op5_embedding_near_dedup": vectors.op5_embedding_near_dedup,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_arc_to_warc": archive.op7_arc_to_warc,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_html_extraction": html.op9_html_extraction,
    "op10_quality_rules": quality.op10_quality_rules,
}

#: The other operators have no SQL form; tests/llm compares them with brute force.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": rlz.ORACLE,
    "op4_suffix_array_dedup": bwt.ORACLE,
    "op7_arc_to_warc": archive.ORACLE,
}
