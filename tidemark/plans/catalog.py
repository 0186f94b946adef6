"""All registered queries (import side effects fill the registry)."""

from __future__ import annotations

import importlib

from tidemark.plans.registry import REGISTRY

_MODULES = ["q_timeline", "q_context", "q_sampling", "q_scoring", "q_concepts", "q_sources", "q_render", "q_omop", "q_cases"]


def _load():
    for m in _MODULES:
        importlib.import_module(f"tidemark.plans.{m}")


def queries():
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql():
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


def flagship(spark, sf_dir):
    _load()
    key = "c_task_index" if "c_task_index" in REGISTRY else "b_runs"
    return REGISTRY[key][0](spark, sf_dir)
