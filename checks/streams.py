"""Streams, run over the events as they lie and in three micro-batches: both must decide as the batch job does."""

from pyspark.sql import functions as F

from checks import ORACLES, QUERIES
from checks.changes import WALK
from checks.requests import ADMISSION
from fixtures import oracle, stream, tables
from tarmac.operators.admission import free_seats
from tarmac.plans.session import tune
from tarmac.sources.work import new_folder, stored
from tarmac.streaming.admission import admit_available
from tarmac.streaming.booking_changes import change_available

ARRIVALS = 3


def in_arrivals(spark, sf_dir, name, order):
    """The feed as a stream of ``ARRIVALS`` micro-batches, each of the rows of a third of the time."""
    (feed,) = tables(spark, sf_dir, name)
    feed, folder = stored(feed, name), new_folder(spark, f"{name}-arriving")
    first, last = feed.agg(F.unix_micros(F.min(order).cast("timestamp")), F.unix_micros(F.max(order).cast("timestamp"))).first()
    third = F.floor((F.unix_micros(F.col(order).cast("timestamp")) - first) * ARRIVALS / (last - first + 1))
    for arrival in range(ARRIVALS):
        feed.where(third == arrival).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def admit_bookings_stream(spark, sf_dir):
    base = tables(tune(spark), sf_dir, "flights", "aircraft", "bookings", "booking_passengers")
    free = stored(free_seats(*base), "free-seats")
    decided = admit_available(stream(spark, sf_dir, "booking_requests"), free)
    return decided.select("request_id", "flight_id", "n_seats", "reason")


def booking_changes_stream(spark, sf_dir):
    (bookings,) = tables(tune(spark), sf_dir, "bookings")
    decided = change_available(stream(spark, sf_dir, "booking_changes"), stored(bookings, "bookings"))
    return decided.select("change_id", "booking_id", F.col("reason").alias("reasons"))


def admit_bookings_arrivals(spark, sf_dir):
    base = tables(tune(spark), sf_dir, "flights", "aircraft", "bookings", "booking_passengers")
    free = stored(free_seats(*base), "free-seats")
    decided = admit_available(in_arrivals(spark, sf_dir, "booking_requests", "request_ts"), free)
    return decided.select("request_id", "flight_id", "n_seats", "reason")


def booking_changes_arrivals(spark, sf_dir):
    (bookings,) = tables(tune(spark), sf_dir, "bookings")
    changes = in_arrivals(spark, sf_dir, "booking_changes", "change_ts")
    decided = change_available(changes, stored(bookings, "bookings"))
    return decided.select("change_id", "booking_id", F.col("reason").alias("reasons"))


QUERIES["admit_bookings_stream"] = admit_bookings_stream
QUERIES["booking_changes_stream"] = booking_changes_stream
QUERIES["admit_bookings_arrivals"] = admit_bookings_arrivals
QUERIES["booking_changes_arrivals"] = booking_changes_arrivals
ORACLES["admit_bookings_stream"] = ORACLES["admit_bookings_arrivals"] = oracle(
    f"""WITH RECURSIVE {ADMISSION} SELECT r.request_id, r.flight_id, r.n_seats,
CASE WHEN w.ok IS NULL THEN 'flight_not_available' WHEN w.ok THEN '' ELSE 'not_enough_seats' END AS reason
FROM booking_requests r LEFT JOIN walk w ON w.request_id = r.request_id"""
)
ORACLES["booking_changes_stream"] = ORACLES["booking_changes_arrivals"] = oracle(
    f"WITH RECURSIVE {WALK} SELECT change_id, booking_id, reasons FROM walk"
)
