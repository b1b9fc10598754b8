"""Session settings the operators count on."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Adaptive execution sizes the partitions and splits the skewed ones; the last setting splits a skewed join even where
# that costs one more shuffle behind it.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to ``spark`` and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


STATIC, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def broadcast_by_rows(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside broadcast a table by the size of its rows, as measured behind a shuffle, under the same limit.

    Before a job Spark knows the size of a table's files only. Where values repeat those are a tenth of the rows or less, so
    that it would send a million rows through the driver as a small table.
    """
    static, measured = spark.conf.get(STATIC), spark.conf.get(MEASURED, None)
    if measured is None:
        spark.conf.set(MEASURED, static)
    spark.conf.set(STATIC, "-1")
    try:
        yield
    finally:
        spark.conf.set(STATIC, static)
        if measured is None:
            spark.conf.unset(MEASURED)
