"""The registered queries by name, each with the DuckDB statement of the same rows where SQL can express it."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) under its own name."""

    def add(f):
        REGISTRY[f.__name__] = Query(f, oracle)
        return f

    return add


from tesserae.plans import cache_plans, census_plans, evidence_plans, flow_plans, job_plans, rule_plans, source_plans  # noqa: E402, F401
