"""The subpackage's queries and, where SQL can express one, its DuckDB statement."""

from __future__ import annotations

from . import decontaminate, fingerprints, line_dedup, lm_scoring, mixing, near_dup, quality, sharding, substring_dedup, url_filters


def queries() -> dict:
    found = (quality.op1_quality, mixing.op2_mixing, fingerprints.op3_fingerprints, line_dedup.op4_line_dedup, sharding.op5_sharding, url_filters.op6_url_filters, near_dup.op7_near_dup, substring_dedup.op8_substring_dedup, lm_scoring.op9_lm_scoring, decontaminate.op10_decontaminate)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.OP2_SQL, "op4_line_dedup": line_dedup.OP4_SQL, "op6_url_filters": url_filters.oracle(), "op7_near_dup": near_dup.OP7_SQL, "op8_substring_dedup": substring_dedup.OP8_SQL}
