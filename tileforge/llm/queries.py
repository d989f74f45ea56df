"""The queries opN_<name> of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from . import bpe, decontaminate, licences, line_dedup, near_dup, quality_model, quality_rules, sharding, token_files, toxicity

_QUERIES = [
    quality_model.op1_quality_model,
    line_dedup.op2_line_dedup,
    toxicity.op3_toxicity_chain,
    licences.op4_licence_scan,
    token_files.op5_token_file,
    near_dup.op6_near_duplicates,
    decontaminate.op7_benchmark_leaks,
    quality_rules.op8_line_rules,
    sharding.op9_feistel_shards,
    bpe.op10_byte_bpe,
]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.op2_sql(),
        "op6_near_duplicates": near_dup.OP6_SQL,
        "op4_licence_scan": licences.op4_sql(),
        "op7_benchmark_leaks": decontaminate.OP7_SQL,
        "op8_line_rules": quality_rules.op8_sql(),
        "op9_feistel_shards": sharding.op9_sql(),
    }
