"""Seat admission: booking requests in order, accepted while their flight has room for all of their passengers.

Seats only ever get fewer, so once a request for n seats is refused on a flight, every later one for n seats is too:
the accepted requests of one size are the first ones of that size, at most ``free // n`` of them. That cuts the queue
of any flight to fewer than ``free * (1 + ln free)`` requests, with ``free`` at most the seats of one aircraft, before
the requests of a flight come together. The cut is done twice, first with each flight spread over ``SPREAD`` parts,
so that a flight with a large share of all requests is not gathered before it is cut.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import rules
from tarmac.functions.expr import OPEN_FLIGHT, booking_reference, class_price
from tarmac.functions.rules import emptied, first_failure
from tarmac.plans.airline import booked_seats
from tarmac.plans.combine import asked_for
from tarmac.plans.lookup import lookup
from tarmac.plans.outcome import Outcome, is_ok
from tarmac.plans.running import running
from tarmac.sources.work import stored

SPREAD = 1024
BOOKING_COLUMNS = ["request_ts", "user_id", "flight_id", "class", "n_seats", "total_amount"]


def free_seats(
    flights: DataFrame, aircraft: DataFrame, bookings: DataFrame, booking_passengers: DataFrame
) -> DataFrame:
    """Open flights with their prices, capacity and free seats, pooled over the classes."""
    on_sale = flights.where(F.col("status").isin(*OPEN_FLIGHT)).join(
        aircraft.select("aircraft_id", "capacity"), "aircraft_id"
    )
    theirs = asked_for(bookings, on_sale, "flight_id")
    return on_sale.join(booked_seats(theirs, booking_passengers, few=True), "flight_id", "left").select(
        "flight_id",
        "base_price",
        "business_price",
        "first_class_price",
        "capacity",
        (F.col("capacity") - F.coalesce("booked_seats", F.lit(0))).alias("free"),
    )


def with_defaults(requests: DataFrame) -> DataFrame:
    """Requests with a class, economy unless given, and the number of seats, counted from the passengers if nested."""
    flight_class = F.coalesce("class", F.lit("economy")) if "class" in requests.columns else F.lit("economy")
    if "passengers" in requests.columns:
        requests = requests.withColumn("n_seats", F.when(F.col("passengers").isNotNull(), F.size("passengers")))
    return requests.withColumn("class", flight_class).withColumn("n_seats", F.col("n_seats").cast("long"))


def priced(asked: DataFrame) -> DataFrame:
    """Requests joined to the free seats of their flight: the amount, and every reason that needs no other request."""
    price = class_price(F.col("class"))
    n = F.coalesce("n_seats", F.lit(0))
    return asked.withColumn(
        "total_amount", (price.cast("decimal(18,2)") * F.col("n_seats")).try_cast("decimal(12,2)")
    ).withColumn(
        "reasons",
        first_failure(
            (F.col("flight_id").isNull() | (n <= 0), "flight_and_passengers_required"),
            (F.col("capacity").isNull(), "flight_not_available"),
            (F.col("total_amount").isNull(), "no_price"),
            (n > F.col("free"), "not_enough_seats"),
        ),
    )


def _first_of_each_size(queue: DataFrame, *parts: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("flight_id", "n_seats", *parts).orderBy("request_ts", "request_id"))
    return queue.withColumn("place", place).where(F.col("place") * F.col("n_seats") <= F.col("free")).drop("place")


def admitted_ids(asked: DataFrame) -> DataFrame:
    """Ids of the requests that get their seats."""
    queue = asked.where(is_ok()).select(
        "flight_id",
        "free",
        "n_seats",
        "request_ts",
        "request_id",
        F.pmod(F.xxhash64("request_id"), F.lit(SPREAD)).alias("part"),
    )
    queue = _first_of_each_size(queue.repartition("flight_id", "n_seats", "part"), "part").drop("part")
    queue = _first_of_each_size(queue.repartition("flight_id"))
    per_flight = queue.groupBy("flight_id").agg(
        F.first("free").cast("long").alias("free"),
        F.sort_array(F.collect_list(F.struct("request_ts", "request_id", "n_seats"))).alias("queue"),
    )
    start = F.struct(F.col("free").alias("free"), F.array().cast("array<bigint>").alias("ids"))

    def admit(state, request):
        taken = F.struct(
            (state["free"] - request["n_seats"]).alias("free"),
            F.concat(state["ids"], F.array(request["request_id"])).alias("ids"),
        )
        return F.when(request["n_seats"] <= state["free"], taken).otherwise(state)

    return per_flight.select(
        F.explode(F.aggregate("queue", start, admit, lambda state: state["ids"])).alias("request_id")
    )


def admit_bookings(
    requests: DataFrame,
    flights: DataFrame,
    aircraft: DataFrame,
    bookings: DataFrame,
    booking_passengers: DataFrame,
) -> Outcome:
    """Decide ``requests`` (request_id, request_ts, user_id, flight_id, class, n_seats or passengers) in time order.

    The priced requests are stored first; the queues and the decisions both read them.
    """
    wanted = asked_for(flights, requests, "flight_id")
    free = free_seats(wanted, aircraft, bookings, booking_passengers)
    asked = stored(priced(lookup(with_defaults(requests), free, ["flight_id"], "request_id")), "priced-requests")
    admitted = admitted_ids(asked).withColumn("admitted", F.lit(True))
    refused = is_ok() & F.col("admitted").isNull()
    decided = asked.join(admitted, "request_id", "left").withColumn(
        "reasons", F.when(refused, F.array(F.lit("not_enough_seats"))).otherwise(F.col("reasons"))
    )
    nested = ["passengers"] if "passengers" in decided.columns else []
    return Outcome(decided, "request_id", [*BOOKING_COLUMNS, *nested])


def booking_rows(accepted: DataFrame, first_id: int) -> DataFrame:
    """Accepted requests as rows of the bookings table; ids start at ``first_id``."""
    return accepted.select(
        (F.lit(first_id) + F.col("request_id")).alias("booking_id"),
        booking_reference(F.col("request_ts"), F.col("request_id")).alias("booking_reference"),
        "user_id",
        "flight_id",
        F.col("request_ts").alias("booking_date"),
        F.col("n_seats").cast("int").alias("number_of_passengers"),
        "class",
        "total_amount",
        F.lit("confirmed").alias("status"),
        F.lit("paid").alias("payment_status"),
        F.lit(None).cast("string").alias("payment_method"),
        F.col("request_ts").alias("created_at"),
        F.col("request_ts").alias("updated_at"),
    )


def _travellers(accepted: DataFrame, first_passenger_id: int) -> DataFrame:
    """One row per passenger of the accepted requests, numbered from 0 by request and place, however many they are.

    ``request_id`` must be unique over the batch.
    """
    sizes = accepted.select("request_id", F.coalesce(F.size("passengers"), F.lit(0)).alias("_n"))
    sizes = sizes.withColumn("_n", F.greatest("_n", F.lit(0)))
    offsets = running(sizes, [F.col("request_id").asc()], {"_before": "_n"})
    accepted = accepted.join(offsets, "request_id")
    number = F.col("_before") + F.col("pos")
    known = F.nullif(F.col("col.passenger_id"), F.lit(0))
    return accepted.select("request_id", "request_ts", "user_id", "_before", F.posexplode("passengers")).select(
        "request_id",
        "request_ts",
        "user_id",
        number.alias("number"),
        known.isNull().alias("is_new"),
        F.coalesce(known, F.lit(first_passenger_id) + number).alias("passenger_id"),
        F.col("col").alias("person"),
    )


def new_passenger_rows(accepted: DataFrame, first_passenger_id: int) -> DataFrame:
    """Passengers of accepted requests that name no passenger_id, as rows of the passengers table."""
    person = F.col("person")
    return (
        _travellers(accepted, first_passenger_id)
        .where("is_new")
        .select(
            "passenger_id",
            "user_id",
            person["first_name"].alias("first_name"),
            person["last_name"].alias("last_name"),
            rules.parsed_date(person["date_of_birth"]).alias("date_of_birth"),
            emptied(person["passport_number"]).alias("passport_number"),
            emptied(person["nationality"]).alias("nationality"),
            F.coalesce(person["save"], F.lit(False)).cast("int").alias("is_saved"),
            F.col("request_ts").alias("created_at"),
        )
    )


def link_rows(accepted: DataFrame, first_booking_id: int, first_passenger_id: int, first_link_id: int) -> DataFrame:
    """Passengers of accepted requests as rows of the booking_passengers table."""
    return _travellers(accepted, first_passenger_id).select(
        (F.lit(first_link_id) + F.col("number")).alias("booking_passenger_id"),
        (F.lit(first_booking_id) + F.col("request_id")).alias("booking_id"),
        "passenger_id",
        emptied(F.col("person.seat_number")).alias("seat_number"),
    )
