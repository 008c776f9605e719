"""The registered queries of this subpackage and their DuckDB SQL, where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import sql
from linkloom.llm.decontaminate import op10_prefix_decontamination
from linkloom.llm.jaccard import op7_count_tree_join
from linkloom.llm.language import op3_cross_parsing_language
from linkloom.llm.licenses import NOTICES, op2_license_scan
from linkloom.llm.mixing import op9_soft_membership_mixing
from linkloom.llm.pii import op4_weak_supervision_pii
from linkloom.llm.quality import op6_pairwise_quality
from linkloom.llm.quotes import op8_quotation_linking
from linkloom.llm.repetition import op5_repetition_coverage
from linkloom.llm.tokens import op1_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scan": op2_license_scan,
    "op3_cross_parsing_language": op3_cross_parsing_language,
    "op4_weak_supervision_pii": op4_weak_supervision_pii,
    "op5_repetition_coverage": op5_repetition_coverage,
    "op6_pairwise_quality": op6_pairwise_quality,
    "op7_count_tree_join": op7_count_tree_join,
    "op8_quotation_linking": op8_quotation_linking,
    "op9_soft_membership_mixing": op9_soft_membership_mixing,
    "op10_prefix_decontamination": op10_prefix_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": sql.op2(NOTICES),
    "op5_repetition_coverage": sql.OP5,
    "op7_count_tree_join": sql.OP7,
    "op10_prefix_decontamination": sql.OP10,
}
