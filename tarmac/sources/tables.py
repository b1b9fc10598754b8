"""The airline tables from parquet files or from a relational database."""

from pyspark.sql import DataFrame, SparkSession

from tarmac.schemas import TABLES, conform

# The column a table is read in parallel by.
PARTITION_COLUMN = {
    "users": "user_id",
    "aircraft": "aircraft_id",
    "flights": "flight_id",
    "bookings": "booking_id",
    "booking_passengers": "booking_passenger_id",
    "passengers": "passenger_id",
    "check_ins": "check_in_id",
}


def load_tables(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    """The tables under ``root``, one folder each, with their declared schemas; all of them unless named."""
    return {n: spark.read.schema(TABLES[n]).parquet(f"{root.rstrip('/')}/{n}") for n in names or TABLES}


def load_jdbc(
    spark: SparkSession, url: str, table: str, properties: dict[str, str], partitions: int = 64, fetch_size: int = 10_000
) -> DataFrame:
    """One table of a database, read in ``partitions`` ranges of its key; airports, which are few, in one.

    Filters and column selections on the result are pushed into the database.
    """
    options = {**properties, "url": url, "fetchsize": str(fetch_size)}
    key = PARTITION_COLUMN.get(table)
    if key is not None:
        bounds = f"(SELECT MIN({key}) AS low, MAX({key}) AS high FROM {table}) bounds"
        low, high = spark.read.format("jdbc").options(**options, dbtable=bounds).load().first()
        if low is not None:
            options |= {
                "partitionColumn": key,
                "lowerBound": str(low),
                "upperBound": str(high + 1),
                "numPartitions": str(partitions),
            }
    return conform(spark.read.format("jdbc").options(**options, dbtable=table).load(), table)
