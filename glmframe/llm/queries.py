"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glmframe.llm.common import read_table
from glmframe.llm.fingerprints import op10_fingerprints
from glmframe.llm.html_template import op6_html_extraction
from glmframe.llm.line_dedup import OP5_SQL, op5_line_dedup
from glmframe.llm.lm_scoring import op12_lm_scoring
from glmframe.llm.merkle_manifest import OP13_SQL, op13_merkle_manifest
from glmframe.llm.near_dedup import op9_near_dedup
from glmframe.llm.packing import op8_packing
from glmframe.llm.piece_viterbi import op3_piece_viterbi
from glmframe.llm.quality_knn import op1_quality_classifier
from glmframe.llm.quality_rules import OP2_SQL, op2_quality_rules
from glmframe.llm.substring_dedup import op4_substring_dedup
from glmframe.llm.token_alignment import op11_token_alignment
from glmframe.llm.token_counts import op7_token_counts


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(read_table(spark, sf_dir, table))

    query.__name__, query.__doc__ = operator.__name__, operator.__doc__
    return query


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_quality_classifier(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": _op1,
    "op2_quality_rules": _over("documents", op2_quality_rules),
    "op3_piece_viterbi": _over("documents", op3_piece_viterbi),
    "op4_substring_dedup": _over("documents", op4_substring_dedup),
    "op5_line_dedup": _over("documents", op5_line_dedup),
    "op6_html_extraction": _over("pages", op6_html_extraction),
    "op7_token_counts": _over("documents", op7_token_counts),
    "op8_packing": _over("documents", op8_packing),
    "op9_near_dedup": _over("documents", op9_near_dedup),
    "op10_fingerprints": _over("documents", op10_fingerprints),
    "op11_token_alignment": _over("documents", op11_token_alignment),
    "op12_lm_scoring": _over("documents", op12_lm_scoring),
    "op13_merkle_manifest": _over("documents", op13_merkle_manifest),
}

#: The other operators can't be put as SQL and are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op5_line_dedup": OP5_SQL, "op13_merkle_manifest": OP13_SQL}
