"""Registered queries of this subpackage and the SQL they agree with."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

MODULES = ("op1_ngram_join", "op2_sharding", "op3_decontamination", "op4_licenses", "op5_html", "op6_repeats", "op7_warc",
           "op8_quality", "op9_mixing", "op10_language", "op11_exact_dedup", "op12_whitening", "op13_vector_codes")


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def load() -> tuple[dict, dict[str, str]]:
    for module in MODULES:
        importlib.import_module(f"fleetlens.llm.{module}")
    return QUERIES, ORACLES
