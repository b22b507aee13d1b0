"""All registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "g9_paired_contrast"
PLANS = ("stimuli", "joins", "inference", "style", "findings", "reports", "checks", "runs")


def _plans():
    return [import_module(f"plumbline.plans.{p}") for p in PLANS]


def queries() -> dict:
    return {k: f for p in _plans() for k, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in _plans() for k, s in p.ORACLES.items()}
