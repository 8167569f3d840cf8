"""The operators as queries over whole tables, and SQL for the results that SQL can express."""

from __future__ import annotations

import importlib

from folium.llm.shared import table

#: Query, module and function, and the tables it reads.
_OPERATORS = [
    ("op1_html_extraction", "html_text", "op1", ["pages"]),
    ("op2_line_dedup", "line_dedup", "op2", ["documents"]),
    ("op3_chat_formatting", "chat_format", "op3", ["conversations"]),
    ("op4_sharding", "sharding", "op4", ["documents"]),
    ("op5_quality_classifier", "quality", "op5", ["documents", "labels"]),
    ("op6_ngram_jaccard_join", "jaccard_join", "op6", ["documents"]),
    ("op7_warc", "warc", "op7", ["pages"]),
    ("op8_benchmark_decontamination", "decontamination", "op8", ["documents", "benchmark"]),
    ("op9_exact_topk_search", "topk_search", "op9", ["embeddings"]),
    ("op10_source_mixing", "mixing", "op10", ["documents"]),
]


def _query(module: str, function: str, tables: list[str]):
    run = getattr(importlib.import_module(f"folium.llm.{module}"), function)
    return lambda spark, sf_dir: run(*[table(spark, sf_dir, name) for name in tables])


def queries() -> dict:
    return {name: _query(module, function, tables) for name, module, function, tables in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    modules = {name: importlib.import_module(f"folium.llm.{module}") for name, module, _, _ in _OPERATORS}
    return {name: module.ORACLE for name, module in modules.items() if hasattr(module, "ORACLE")}
