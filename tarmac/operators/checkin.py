"""Check-in: who may check in now, and confirmation with seats. ``now`` is the clock."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import rules
from tarmac.functions.collation import lower_or_compared
from tarmac.functions.expr import instant
from tarmac.functions.rules import emptied, failures, first_failure, text
from tarmac.operators.listings import nested_passengers, on_flights, passenger_rows
from tarmac.plans.airline import passengers_per_booking
from tarmac.plans.combine import asked_for
from tarmac.plans.lookup import lookup
from tarmac.plans.outcome import Outcome
from tarmac.sources.work import stored

# The window before departure, boarding time and the gate where none is given.
WINDOW_HOURS = 24
BOARDING = "INTERVAL 30 MINUTES"
NO_GATE = "TBA"


def _departed(now: datetime | str) -> Column:
    return F.col("departure_datetime") < instant(now)


def _too_early(now: datetime | str) -> Column:
    return F.col("departure_datetime") > instant(now) + F.expr(f"INTERVAL {WINDOW_HOURS} HOURS")


def checkin_eligibility(
    requests: DataFrame,
    bookings: DataFrame,
    flights: DataFrame,
    airports: DataFrame,
    booking_passengers: DataFrame,
    passengers: DataFrame,
    check_ins: DataFrame,
    now: datetime | str,
    collation: str | None = None,
) -> Outcome:
    """Decide ``requests`` (request_id, user_id, booking_reference, last_name); the first failing check is the reason.

    Last names are compared by ``collation``, without one in lower case.

    The bookings asked for are stored first. Only a completed check-in counts as checked in. ``opens_in_hours`` is set where the window is not open yet.
    """
    low, high = rules.BOOKING_REFERENCE_LENGTH
    asked = requests.select(
        "request_id",
        F.col("user_id").alias("requester_id"),
        text(F.col("booking_reference")).alias("booking_reference"),
        text(F.col("last_name")).alias("last_name"),
    )
    reference = F.col("booking_reference")
    invalid = ~F.length(reference).between(low, high) | ~reference.rlike(rules.BOOKING_REFERENCE)
    for failed, _ in rules.name_rules("last_name", F.col("last_name")):
        invalid = invalid | failed

    wanted = asked_for(bookings, asked, "booking_reference")
    place = F.row_number().over(Window.partitionBy("booking_reference").orderBy("booking_id"))
    found = (
        on_flights(wanted, flights, airports)
        .withColumn("_place", place)
        .where(F.col("_place") == 1)
        .withColumnsRenamed({"from_airport_code": "from_code", "to_airport_code": "to_code"})
    )
    first_check_in = (
        asked_for(check_ins, wanted, "booking_id")
        .groupBy("booking_id")
        .agg(F.min_by("status", "check_in_id").alias("check_in_status"))
    )
    found = stored(found.drop("_place").join(first_check_in, "booking_id", "left"), "asked-bookings")
    theirs = asked_for(booking_passengers, found.where(F.col("status") == "confirmed"), "booking_id")
    names = (
        passenger_rows(theirs, passengers)
        .join(found.select("booking_id", "booking_reference"), "booking_id")
        .select("booking_reference", lower_or_compared(F.col("last_name"), collation).alias("lower_name"))
        .distinct()
        .withColumn("name_known", F.lit(True))
    )
    hours = F.timestamp_diff("MILLISECOND", instant(now), F.col("departure_datetime")) / 3600000
    asked = asked.withColumn("invalid", invalid).withColumn(
        "lower_name", lower_or_compared(F.col("last_name"), collation)
    )
    with_booking = lookup(asked, found, ["booking_reference"], "request_id")
    decided = (
        lookup(with_booking, names, ["booking_reference", "lower_name"], "request_id", counted=asked)
        .withColumn(
            "reasons",
            first_failure(
                (F.col("invalid"), "invalid_request"),
                (F.col("booking_id").isNull(), "booking_not_found"),
                (~F.col("user_id").eqNullSafe(F.col("requester_id")), "access_denied"),
                (~F.col("status").eqNullSafe(F.lit("confirmed")), "not_confirmed"),
                (F.col("name_known").isNull(), "last_name_mismatch"),
                (F.col("check_in_status") == "completed", "already_checked_in"),
                (_departed(now), "departed"),
                (_too_early(now), "window_not_open"),
            ),
        )
        .withColumn(
            "opens_in_hours",
            F.when(F.get("reasons", F.lit(0)) == "window_not_open", F.ceil(hours - WINDOW_HOURS).cast("long")),
        )
    )
    return Outcome(
        decided,
        "request_id",
        [
            "booking_id",
            "booking_reference",
            "user_id",
            "flight_id",
            "booking_date",
            "number_of_passengers",
            "class",
            "total_amount",
            "status",
            "payment_status",
            "flight_number",
            "departure_datetime",
            "arrival_datetime",
            "flight_status",
            "from_code",
            "from_name",
            "from_city",
            "to_code",
            "to_name",
            "to_city",
        ],
    )


def eligible_with_passengers(accepted: DataFrame, booking_passengers: DataFrame, passengers: DataFrame) -> DataFrame:
    """Eligible requests with the nested passengers of their booking, by last and first name."""
    theirs = asked_for(booking_passengers, accepted, "booking_id")
    by_name = ("last_name", "first_name", "booking_passenger_id")
    return accepted.join(nested_passengers(theirs, passengers, order=by_name), "booking_id")


def confirm_checkins(
    requests: DataFrame,
    bookings: DataFrame,
    flights: DataFrame,
    booking_passengers: DataFrame,
    check_ins: DataFrame,
    now: datetime | str,
) -> Outcome:
    """Decide ``requests`` (request_id, user_id, booking_id, seat_numbers, gate_number).

    Any check-in row counts as checked in, and the first valid request of a booking makes the later ones so. Whether a
    seat is free is not tested.
    """
    seats = F.col("seat_numbers")
    no_seats = F.coalesce(F.size(seats), F.lit(0)) <= 0
    blank_seat = F.exists(seats, lambda s: text(s) == "")
    checked_in = asked_for(check_ins, requests, "booking_id").select("booking_id").distinct().withColumn("checked_in", F.lit(True))
    departures = flights.select("flight_id", F.lit(True).alias("flight_known"), "departure_datetime")
    booking = (
        asked_for(bookings, requests, "booking_id")
        .select("booking_id", F.col("user_id").alias("owner_id"), "flight_id", "status")
        .join(departures, "flight_id", "left")
        .join(checked_in, "booking_id", "left")
        .join(passengers_per_booking(asked_for(booking_passengers, requests, "booking_id")), "booking_id", "left")
    )
    looked_up = lookup(requests, booking, ["booking_id"], "request_id")
    asked = looked_up.withColumns(
        {
            "early": failures(
                (F.coalesce(F.col("booking_id") < 1, F.lit(True)), "booking_id_invalid"),
                (no_seats, "seat_numbers_required"),
                (blank_seat, "seat_number_blank"),
                rules.length_rule("gate_number", F.col("gate_number"), rules.GATE_LENGTH),
            ),
            "missing": ~(F.col("owner_id").eqNullSafe(F.col("user_id")) & F.col("status").eqNullSafe(F.lit("confirmed"))),
            "late": first_failure(
                (F.col("flight_known").isNull(), "flight_not_found"),
                (_departed(now), "departed"),
                (_too_early(now), "window_not_open"),
                (F.size(seats) != F.coalesce("passenger_count", F.lit(0)), "seat_count_mismatch"),
            ),
        }
    )
    open_request = (F.size("early") == 0) & ~F.col("missing") & F.col("checked_in").isNull()
    first = (
        asked.where(open_request & (F.size("late") == 0))
        .groupBy("booking_id")
        .agg(F.min("request_id").alias("first_id"))
    )
    done = F.col("checked_in").isNotNull() | F.coalesce(F.col("first_id") < F.col("request_id"), F.lit(False))
    decided = lookup(asked, first, ["booking_id"], "request_id", counted=requests).select(
        "request_id",
        "booking_id",
        "seat_numbers",
        instant(now).alias("check_in_datetime"),
        F.coalesce(emptied(text(F.col("gate_number"))), F.lit(NO_GATE)).alias("gate_number"),
        (F.col("departure_datetime") - F.expr(BOARDING)).alias("boarding_time"),
        F.when(F.size("early") > 0, F.col("early"))
        .when(F.col("missing"), F.array(F.lit("booking_not_found")))
        .when(done, F.array(F.lit("already_checked_in")))
        .otherwise(F.col("late"))
        .alias("reasons"),
    )
    return Outcome(
        decided, "request_id", ["booking_id", "seat_numbers", "check_in_datetime", "gate_number", "boarding_time"]
    )


def check_in_rows(accepted: DataFrame, first_id: int) -> DataFrame:
    """Accepted confirmations as rows of the check_ins table; ids start at ``first_id``."""
    return accepted.select(
        (F.lit(first_id) + F.col("request_id")).alias("check_in_id"),
        "booking_id",
        "check_in_datetime",
        "gate_number",
        "boarding_time",
        F.lit("completed").alias("status"),
    )


def seat_updates(accepted: DataFrame, booking_passengers: DataFrame) -> DataFrame:
    """The i-th seat of a confirmation for the i-th passenger row of its booking.

    Passengers are numbered within accepted bookings only, which have as many as the request has seats.
    """
    theirs = asked_for(booking_passengers, accepted, "booking_id")
    place = F.row_number().over(Window.partitionBy("booking_id").orderBy("booking_passenger_id")) - 1
    numbered = theirs.select("booking_id", "booking_passenger_id", place.alias("pos"))
    seats = accepted.select("booking_id", F.posexplode("seat_numbers").alias("pos", "seat"))
    return numbered.join(seats, ["booking_id", "pos"]).select(
        "booking_passenger_id", F.upper(text(F.col("seat"))).alias("seat_number")
    )


def with_seats(booking_passengers: DataFrame, updates: DataFrame) -> DataFrame:
    """The booking_passengers table after ``updates``."""
    renamed = updates.withColumnRenamed("seat_number", "_seat")
    return (
        booking_passengers.join(renamed, "booking_passenger_id", "left")
        .withColumn("seat_number", F.coalesce("_seat", "seat_number"))
        .drop("_seat")
    )
