"""The joins the airline tables share.

Facts are reduced on their own key before they meet another table: a flight, booking or airport that holds a large
part of all rows is combined map-side and arrives at the join as one row. Airports and aircraft carry no broadcast
hint; Spark broadcasts them when their size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and
merges, splitting skewed partitions at run time.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.expr import ON_TIME_FLIGHT, route_name


def airport_side(airports: DataFrame, side: str) -> DataFrame:
    """Airports under the column names of the departure (``from``) or arrival (``to``) end of a flight."""
    return airports.select(
        F.col("airport_code").alias(f"{side}_airport_code"),
        F.col("airport_name").alias(f"{side}_name"),
        F.col("city").alias(f"{side}_city"),
        F.col("country").alias(f"{side}_country"),
    )


def with_airports(df: DataFrame, airports: DataFrame) -> DataFrame:
    """Inner join of both ends; rows with an unknown airport go."""
    return df.join(airport_side(airports, "from"), "from_airport_code").join(
        airport_side(airports, "to"), "to_airport_code"
    )


def with_aircraft(df: DataFrame, aircraft: DataFrame) -> DataFrame:
    return df.join(aircraft.select("aircraft_id", F.col("model").alias("aircraft_model"), "capacity"), "aircraft_id")


def route_totals(
    bookings: DataFrame,
    flights: DataFrame,
    airports: DataFrame,
    partial: dict[str, Column],
    combine: dict[str, Column],
    keys: tuple[str, ...] = ("from_city", "to_city"),
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Totals of bookings per route, reduced step by step: flight, airport pair, then ``keys``.

    ``partial`` is computed per flight (and per ``by`` column) before the flights join; ``combine`` is computed over
    its results and over the flight's columns, and every one of them is a sum.
    """
    per_flight = bookings.groupBy("flight_id", *by).agg(*[c.alias(n) for n, c in partial.items()])
    per_pair = (
        per_flight.join(flights, "flight_id")
        .groupBy("from_airport_code", "to_airport_code")
        .agg(*[F.sum(c).alias(n) for n, c in combine.items()])
    )
    return (
        with_airports(per_pair, airports)
        .groupBy(*keys)
        .agg(*[F.sum(n).alias(n) for n in combine])
        .withColumn("route", route_name(F.col("from_city"), F.col("to_city")))
    )


def passengers_per_booking(booking_passengers: DataFrame) -> DataFrame:
    return booking_passengers.groupBy("booking_id").agg(F.count("*").alias("passenger_count"))


def booked_seats(bookings: DataFrame, booking_passengers: DataFrame, few: bool = False) -> DataFrame:
    """Seats taken per flight: passenger rows of bookings that are not cancelled.

    ``few`` says that ``bookings`` are a small part of the table: they pick their passenger rows where those lie,
    rather than wait for the counts of all bookings.
    """
    held = bookings.where(F.col("status") != "cancelled").select("booking_id", "flight_id")
    if few:
        return booking_passengers.join(held, "booking_id").groupBy("flight_id").agg(F.count("*").alias("booked_seats"))
    return (
        passengers_per_booking(booking_passengers)
        .join(held, "booking_id")
        .groupBy("flight_id")
        .agg(F.sum("passenger_count").alias("booked_seats"))
    )


def fleet_seats(flights: DataFrame, aircraft: DataFrame) -> DataFrame:
    """Flights per aircraft, all and on-time ones, with its capacity."""
    per_aircraft = flights.groupBy("aircraft_id").agg(
        F.count("*").alias("flight_count"), F.count_if(F.col("status").isin(*ON_TIME_FLIGHT)).alias("active_count")
    )
    return per_aircraft.join(aircraft.select("aircraft_id", "capacity"), "aircraft_id")
