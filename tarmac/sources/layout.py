"""Tables written for the jobs that read them: bookings by month, and what meets on a booking by its bucket.

Everything here is plain Parquet by ``DataFrameWriter``. A job writes its tables to a folder of its own; versions and
concurrent writers are for the catalogue or table format that the cluster has.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.schemas import BOOKING_MONTH, TABLES, conform

BUCKETS = 200


def _by_month(bookings: DataFrame) -> DataFrame:
    """Bookings with their month, rebalanced rather than hashed by it: a large month is written by several tasks."""
    dated = conform(bookings, "bookings").withColumn(BOOKING_MONTH, F.date_format("booking_date", "yyyy-MM"))
    return dated.hint("rebalance", F.col(BOOKING_MONTH))


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Each table to its folder under ``root``, which must not hold it yet; bookings partitioned by booking month."""
    for name, df in tables.items():
        path = f"{root.rstrip('/')}/{name}"
        if name == "bookings":
            _by_month(df).write.partitionBy(BOOKING_MONTH).parquet(path)
        else:
            conform(df, name).write.parquet(path)


def write_months(bookings: DataFrame, root: str) -> None:
    """Replace the months that ``bookings`` have by these rows; files of other months stay as they are.

    ``bookings`` must not be read from the same folder: store them first.
    """
    writer = _by_month(bookings).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(BOOKING_MONTH).parquet(f"{root.rstrip('/')}/bookings")


def read_bookings(spark: SparkSession, root: str) -> DataFrame:
    """Bookings under ``root`` with ``booking_month``, by which a filter prunes folders."""
    schema = f"{TABLES['bookings']}, {BOOKING_MONTH} STRING"
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/bookings")


def save_bucketed(df: DataFrame, name: str, saved_as: str, path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Save bookings, booking_passengers or check_ins as a catalogue table, bucketed and sorted by booking.

    Tables of the same number of buckets meet on booking_id, and are grouped by it, without an exchange. A bucket holds
    whole bookings; a booking has at most as many passengers as an aircraft has seats. Rows are dealt by bucket first, so
    that each bucket is one file. ``path`` makes the table external.
    """
    rows = conform(df, name).repartition(buckets, "booking_id")
    writer = rows.write.format("parquet").bucketBy(buckets, "booking_id").sortBy("booking_id")
    (writer.option("path", path) if path else writer).saveAsTable(saved_as)
    return df.sparkSession.table(saved_as)
