"""Query registry: every named query is a ``(spark, sf_dir) -> DataFrame`` callable over
the driver's tables, optionally paired with an equivalent DuckDB SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from latewise.plans.oracle_fixture import cte

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is a SQL body that may use the fixture CTE names."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = cte(oracle)
        return fn
    return deco


_FIXTURES: dict[tuple[int, str], object] = {}


def fixture(spark: SparkSession, sf_dir: str):
    """One lazily built fixture per (session, directory)."""
    from latewise.sources.fixture import Fixture
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _FIXTURES:
        _FIXTURES[key] = Fixture(spark, sf_dir)
    return _FIXTURES[key]


def load_all() -> None:
    """Import every query module so that its registrations run."""
    import importlib
    import pkgutil

    import latewise.plans as pkg
    for m in pkgutil.iter_modules(pkg.__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"latewise.plans.{m.name}")
