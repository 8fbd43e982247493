from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.session import configure

from .fixture import Fixture
from .sql import expand

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None):
    """Register a function of a Fixture under a query name, with its SQL over the raw tables.

    In the SQL, {{name}} pulls in a common table expression of sql.py.
    """

    def wrap(build: Callable[[Fixture], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Fixture(configure(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = expand(sql)
        return build

    return wrap


def micro(value, name: str) -> Column:
    """A double as whole millionths, so engines that differ in the last bit still agree.

    The cut is at 0.7 of a millionth, which no multiple of a power of two comes near.
    """
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value * 1e6 + 0.3).cast("bigint").alias(name)
