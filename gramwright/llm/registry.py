"""Queries of this subpackage for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: query: (module, function); modules are imported when a query is first called for.
QUERIES = {
    "op9_tool_call_linking": ("tool_calls", "op9"),
    "op3_suffix_array_dedup": ("suffix_dedup", "op3"),
    "op1_minhash_odd_sketches": ("near_dedup", "op1"),
    "op6_weak_supervision": ("quality", "op6"),
    "op10_line_dedup": ("line_dedup", "op10"),
    "op4_personal_data": ("pii", "op4"),
    "op5_toxicity": ("toxicity", "op5"),
    "op2_token_records": ("records", "op2"),
    "op7_cost_balanced_packing": ("packing", "op7"),
    "op8_benchmark_decontamination": ("decontaminate", "op8"),
}


def queries() -> dict[str, Callable]:
    return {name: getattr(import_module(f"{__package__}.{module}"), function) for name, (module, function) in QUERIES.items()}


#: query: (module, name of its SQL).
ORACLES = {
    "op1_minhash_odd_sketches": ("oracle", "NEAR_DEDUP"),
    "op8_benchmark_decontamination": ("oracle", "BENCHMARK"),
    "op9_tool_call_linking": ("tool_calls", "ORACLE"),
    "op10_line_dedup": ("line_dedup", "ORACLE"),
}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"{__package__}.{module}"), sql) for name, (module, sql) in ORACLES.items()}
