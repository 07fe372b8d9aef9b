"""Every registered query of the library with its SQL counterpart."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import PREFIX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Decimals that doubles are compared at.
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{c}`"), DIGITS) + F.lit(0.0)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Registers a query; sql goes on after the views of fixtures.PREFIX, doubles are its columns to round."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            body = f"{PREFIX}{',' if sql.lstrip().startswith('|') else ''} {sql.lstrip().lstrip('|')}"
            swap = ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in doubles.split())
            ORACLE_SQL[name] = f"SELECT * {f'REPLACE ({swap})' if swap else ''} FROM ({body})"
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_gate_metrics"](spark, sf_dir)


for _module in ("bars_plans", "window_plans", "log_plans", "join_plans", "scalar_plans", "gate_plans", "fold_plans", "model_plans", "tower_plans"):
    try:
        importlib.import_module(f"tapeflow.plans.{_module}")
    except ModuleNotFoundError as e:
        if e.name != f"tapeflow.plans.{_module}":
            raise
