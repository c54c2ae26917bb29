"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _plans() -> list:
    from quern.plans import answers, dialogue, graph, language, retrieval

    return [retrieval, language, graph, dialogue, answers]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for plan in _plans():
        out |= plan.QUERIES
    return out


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for plan in _plans():
        out |= plan.ORACLES
    return out
