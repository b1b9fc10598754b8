"""Tables written in the layouts of the library and read back."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import ORACLES, QUERIES
from checks.listings import SEATS
from fixtures import oracle, tables
from tarmac.plans import airline
from tarmac.plans.session import tune
from tarmac.schemas import TABLES
from tarmac.sources.layout import read_bookings, save_bucketed, write_months, write_tables
from tarmac.sources.tables import load_tables as load
from tarmac.sources.work import new_folder

COLUMNS = {n: [tuple(c.split(" ")) for c in ddl.split(", ")] for n, ddl in TABLES.items()}
# Columns that not all fixtures have and a table then holds as nulls.
ABSENT = {"check_ins": {"check_in_datetime", "gate_number", "boarding_time"}}


def load_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every table, loaded from its folder: rows, values that are not null, and characters of all texts."""
    root = new_folder(tune(spark), "tables")
    write_tables(dict(zip(TABLES, tables(spark, sf_dir, *TABLES), strict=True)), root)
    found = []
    for name, df in load(spark, root).items():
        texts = [c for c, kind in COLUMNS[name] if kind == "STRING"]
        values = reduce(lambda a, b: a + b, [F.count(c) for c, _ in COLUMNS[name]])
        size = reduce(lambda a, b: a + b, [F.coalesce(F.sum(F.length(c)), F.lit(0)) for c in texts], F.lit(0))
        found.append(
            df.agg(F.count("*").alias("row_count"), values.alias("values"), size.cast("long").alias("characters")).select(
                F.lit(name).alias("name"), "row_count", "values", "characters"
            )
        )
    return reduce(DataFrame.unionByName, found)


def write_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings and their amounts by month, after a job has doubled the amounts of one month and rewritten only that."""
    root = new_folder(tune(spark), "by-month")
    bookings, airports = tables(spark, sf_dir, "bookings", "airports")
    write_tables({"airports": airports, "bookings": bookings}, root)
    january = bookings.where("date_format(booking_date, 'yyyy-MM') = '1998-01'")
    write_months(january.withColumn("total_amount", F.col("total_amount") * 2), root)
    amount = F.sum("total_amount").cast("decimal(38,2)")
    return read_bookings(spark, root).groupBy("booking_month").agg(F.count("*").alias("row_count"), amount.alias("amount"))


def booked_seats_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seats taken per flight from tables that lie in buckets of bookings."""
    names, found = ("bookings", "booking_passengers"), []
    for name, df in zip(names, tables(tune(spark), sf_dir, *names), strict=True):
        found.append(save_bucketed(df, name, f"{name}_{uuid.uuid4().hex}", new_folder(spark, f"{name}-bucketed"), 8))
    return airline.booked_seats(*found)


QUERIES["load_tables"] = load_tables
QUERIES["write_snapshot"] = write_snapshot
QUERIES["booked_seats_bucketed"] = booked_seats_bucketed


def _contents(name: str) -> str:
    fields = [(c, kind) for c, kind in COLUMNS[name] if c not in ABSENT.get(name, ())]
    values = " + ".join(f"count({c})" for c, _ in fields)
    texts = [f"coalesce(sum(length({c})), 0)" for c, kind in fields if kind == "STRING"]
    return f"SELECT '{name}' AS name, count(*) AS row_count, {values} AS values, CAST({' + '.join(texts) or 0} AS BIGINT) AS characters FROM {name}"


ORACLES["load_tables"] = oracle(" UNION ALL ".join(map(_contents, TABLES)))
ORACLES["write_snapshot"] = oracle(
    """SELECT strftime(booking_date, '%Y-%m') AS booking_month, count(*) AS row_count,
sum(CASE WHEN strftime(booking_date, '%Y-%m') = '1998-01' THEN 2 ELSE 1 END * total_amount) AS amount
FROM bookings GROUP BY 1"""
)
ORACLES["booked_seats_bucketed"] = oracle(f"SELECT flight_id, n AS booked_seats FROM {SEATS} s")
