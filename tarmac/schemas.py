"""Table layouts: the eight airline tables and the request feeds the operators take in."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TABLES = {
    "users": (
        "user_id BIGINT, first_name STRING, last_name STRING, email STRING, phone STRING, date_of_birth DATE, "
        "address STRING, role STRING, status STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
    "airports": "airport_code STRING, airport_name STRING, city STRING, country STRING",
    "aircraft": (
        "aircraft_id BIGINT, model STRING, registration STRING, capacity INT, status STRING, "
        "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
    "flights": (
        "flight_id BIGINT, flight_number STRING, aircraft_id BIGINT, from_airport_code STRING, "
        "to_airport_code STRING, departure_datetime TIMESTAMP_NTZ, arrival_datetime TIMESTAMP_NTZ, status STRING, "
        "base_price DECIMAL(10,2), business_price DECIMAL(10,2), first_class_price DECIMAL(10,2), "
        "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
    "bookings": (
        "booking_id BIGINT, booking_reference STRING, user_id BIGINT, flight_id BIGINT, booking_date TIMESTAMP_NTZ, "
        "number_of_passengers INT, class STRING, total_amount DECIMAL(12,2), status STRING, payment_status STRING, "
        "payment_method STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
    "booking_passengers": "booking_passenger_id BIGINT, booking_id BIGINT, passenger_id BIGINT, seat_number STRING",
    "passengers": (
        "passenger_id BIGINT, user_id BIGINT, first_name STRING, last_name STRING, date_of_birth DATE, "
        "passport_number STRING, nationality STRING, is_saved INT, created_at TIMESTAMP_NTZ"
    ),
    "check_ins": (
        "check_in_id BIGINT, booking_id BIGINT, check_in_datetime TIMESTAMP_NTZ, gate_number STRING, "
        "boarding_time TIMESTAMP_NTZ, status STRING"
    ),
}

# The partition column of stored bookings: the month of booking_date as yyyy-MM.
BOOKING_MONTH = "booking_month"


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the columns of ``table``: cast to the declared types, nulls where it has none."""
    present = set(df.columns)
    return df.selectExpr(
        [
            f"CAST({f.name if f.name in present else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in T.StructType.fromDDL(TABLES[table]).fields
        ]
    )
