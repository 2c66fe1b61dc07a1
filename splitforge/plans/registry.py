"""All registered plans by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from splitforge.plans import assembly, comparison, expressions, files, robustness, verification

MODULES = (expressions, files, assembly, verification, robustness, comparison)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: plan for m in MODULES for name, (plan, _) in m.PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.PLANS.items() if sql}
