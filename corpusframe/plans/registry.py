"""Name -> query and name -> SQL of every job that runs over the shared tables."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

import corpusframe.plans as plans


def _modules():
    for m in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        if m.name.startswith("q_"):
            yield importlib.import_module(f"corpusframe.plans.{m.name}")


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _modules() for name, s in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["R10_hybrid"](spark, sf_dir)
