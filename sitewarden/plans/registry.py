"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitewarden.plans.roles import Tables
from sitewarden.session import ship_package

Plan = Callable[[Tables], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under ``name``, with its SQL where there is one."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from sitewarden.plans import aggregates, filtering, importing, linking, norms, reporting, searching  # noqa: F401


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return PLANS[name](Tables(spark, folder))
