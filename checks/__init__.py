"""The registered queries: each runs an operator on the fixture tables and names the SQL that must agree with it."""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtures import oracle, tables
from tarmac.plans.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WRITTEN: dict[str, str] = {}


def check(reads: str, sql: str | None = None):
    """Register a function of the fixture tables named in ``reads``, under its own name, with its oracle ``sql``."""

    def register(run: Callable[..., DataFrame]):
        @wraps(run)
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(*tables(tune(spark), sf_dir, *reads.split()))

        QUERIES[run.__name__] = query
        if sql is not None:
            ORACLES[run.__name__], WRITTEN[run.__name__] = oracle(sql), sql
        return run

    return register


def text(array: str, *fields: str) -> Column:
    """An array of structs as one text, for comparison across engines."""
    return F.array_join(
        F.transform(array, lambda x: F.concat_ws("=", *[x[f].cast("string") for f in fields])), "; "
    ).alias(array)
