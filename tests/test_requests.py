"""Request tables: every reason, and who wins a unique value."""

from decimal import Decimal

from rows import frame, reasons, table, ts
from tarmac.operators import requests

AS_OF = "2001-07-15"
REGISTRATION = (
    "request_id BIGINT, first_name STRING, last_name STRING, email STRING, password STRING, confirm_password STRING, "
    "phone STRING, dob STRING, address STRING"
)


def registration(i, **columns):
    good = {
        "request_id": i,
        "first_name": "Ann",
        "last_name": "O'Neil-Smith",
        "email": f"a{i}@example.com",
        "password": "Passw0rd",
        "confirm_password": "Passw0rd",
    }
    return {**good, **columns}


def register(spark, *rows):
    users = table(spark, "users", {"user_id": 1, "email": "taken@example.com"})
    return requests.register_users(frame(spark, REGISTRATION, list(rows)), users, AS_OF)


def test_registration_reasons(spark):
    got = reasons(
        register(
            spark,
            registration(1),
            registration(2, first_name=None),
            registration(3, last_name=" x "),
            registration(4, last_name="R2D2"),
            registration(5, email="a@b"),
            registration(6, email="a" * 60 + "@" + "b" * 200 + ".example"),
            registration(7, password="Ab1", confirm_password="Ab1"),
            registration(8, password="passw0rd"),
            registration(9, phone="call me"),
            registration(10, phone="+" + "1" * 20),
            registration(11, dob="2001-02-30"),
            registration(12, dob="1880-01-01"),
            registration(13, dob="1881-12-31"),
            registration(14, dob="2002-01-01"),
            registration(15, address="x" * 501),
            registration(16, email="x" * 65 + "@example.com"),
            registration(17, phone="  "),
            registration(18, password=None, confirm_password=None),
        ).decided
    )
    assert got == {
        1: [],
        2: ["first_name_required", "first_name_length", "first_name_characters"],
        3: ["last_name_length"],
        4: ["last_name_characters"],
        5: ["email_format"],
        6: ["email_length"],
        7: ["password_length"],
        8: ["password_strength", "password_confirmation"],
        9: ["phone_format"],
        10: ["phone_length"],
        11: ["date_of_birth_format"],
        12: ["date_of_birth_range"],
        13: [],
        14: ["date_of_birth_range"],
        15: ["address_length"],
        16: ["email_format"],
        17: ["phone_format"],
        18: ["password_length", "password_strength"],
    }


def test_earliest_valid_request_gets_the_email(spark):
    outcome = register(
        spark,
        registration(1, email="same@example.com", first_name="1"),
        registration(2, email=" Same@Example.com "),
        registration(3, email="same@example.com"),
        registration(4, email="taken@example.com"),
    )
    got = reasons(outcome.decided)
    assert got[1] and got[2] == [] and got[3] == got[4] == ["email_taken"]
    (accepted,) = outcome.accepted.collect()
    assert (accepted.request_id, accepted.email, accepted.role) == (2, "same@example.com", "user")
    assert "password" not in outcome.accepted.columns
    assert sorted(r.request_id for r in outcome.rejected.collect()) == [1, 3, 4]


def test_passengers(spark):
    ddl = (
        "request_id BIGINT, user_id BIGINT, first_name STRING, last_name STRING, date_of_birth STRING, "
        "passport_number STRING, nationality STRING"
    )
    good = {"user_id": 1, "first_name": "Ann", "last_name": "Lee"}
    rows = [
        {**good, "request_id": 1, "passport_number": " ", "date_of_birth": "1999-12-31"},
        {**good, "request_id": 2, "first_name": "A"},
        {**good, "request_id": 3, "last_name": "Le3"},
        {**good, "request_id": 4, "date_of_birth": "1880-06-01"},
        {**good, "request_id": 5, "passport_number": "p" * 51, "nationality": "n" * 101},
    ]
    outcome = requests.add_passengers(frame(spark, ddl, rows), AS_OF)
    assert reasons(outcome.decided) == {
        1: [],
        2: ["first_name_length"],
        3: ["last_name_characters"],
        4: ["date_of_birth_range"],
        5: ["passport_number_length", "nationality_length"],
    }
    (row,) = outcome.accepted.collect()
    assert (row.passport_number, row.is_saved) == (None, 1)


def test_aircraft(spark):
    ddl = "request_id BIGINT, model STRING, registration STRING, capacity STRING, status STRING"
    rows = [
        (1, "A1", " AB-1 ", "1", None),
        (2, "A1", "ab-2", "5", "active"),
        (3, "", "AB-3", "0", "active"),
        (4, "m" * 101, "AB-4", "1001", "broken"),
        (5, "A1", "", "abc", "retired"),
        (6, "A1", "X" * 21, "1000", "maintenance"),
        (7, "A1", "AB-1", "10", None),
        (8, "A1", "OLD-1", "10", None),
        (9, "A1", "AB-9", None, ""),
    ]
    feed = frame(spark, ddl, [dict(zip(["request_id", "model", "registration", "capacity", "status"], r)) for r in rows])
    fleet = table(spark, "aircraft", {"aircraft_id": 1, "registration": "OLD-1"})
    outcome = requests.create_aircraft(feed, fleet)
    assert reasons(outcome.decided) == {
        1: [],
        2: ["registration_characters"],
        3: ["model_required", "capacity_range"],
        4: ["model_length", "capacity_range", "status_unknown"],
        5: ["registration_required", "registration_characters", "capacity_range"],
        6: ["registration_length"],
        7: ["registration_taken"],
        8: ["registration_taken"],
        9: ["capacity_range", "status_unknown"],
    }
    (row,) = outcome.accepted.collect()
    assert (row.registration, row.capacity, row.status) == ("AB-1", 1, "active")


FLIGHT = (
    "request_id BIGINT, flight_number STRING, aircraft_id STRING, from_airport_code STRING, to_airport_code STRING, "
    "departure_datetime STRING, arrival_datetime STRING, base_price STRING, business_price STRING, "
    "first_class_price STRING, status STRING"
)


def flight(i, **columns):
    good = {
        "request_id": i,
        "flight_number": f"N{i}",
        "aircraft_id": "12abc",
        "from_airport_code": "A",
        "to_airport_code": "B",
        "departure_datetime": "2001-08-01 10:00:00",
        "arrival_datetime": "2001-08-01T12:00:00",
        "base_price": "33.33",
    }
    return {**good, **columns}


def test_flights(spark):
    flights = table(spark, "flights", {"flight_id": 1, "flight_number": "OLD"})
    required = [
        "flight_number",
        "aircraft_id",
        "from_airport_code",
        "to_airport_code",
        "departure_datetime",
        "arrival_datetime",
        "base_price",
    ]
    rows = [flight(i, **{name: None}) for i, name in enumerate(required)]
    rows += [
        flight(10, flight_number="OLD", departure_datetime="soon"),
        flight(11, departure_datetime="soon"),
        flight(12, arrival_datetime="2001-08-01 10:00:00"),
        flight(13, flight_number="SAME", arrival_datetime="2001-08-01 09:00:00"),
        flight(14, flight_number="SAME", business_price="0", first_class_price="0.00"),
        flight(15, flight_number="SAME"),
        flight(16, flight_number="SAME", arrival_datetime="2001-08-01 09:00:00"),
        flight(17, business_price="70", first_class_price=None, status="boarding"),
        flight(18, base_price="cheap"),
        flight(19, base_price="0"),
        flight(20, business_price="abc"),
        flight(21, first_class_price="99999999999"),
        flight(22, base_price="60000000", first_class_price=""),
        flight(23, business_price="-99999999999"),
        flight(24, business_price=""),
    ]
    outcome = requests.create_flights(frame(spark, FLIGHT, rows), flights)
    got = reasons(outcome.decided)
    assert all(got[i] == ["missing_fields"] for i in range(7))
    assert {i: got[i] for i in range(10, 25)} == {
        10: ["flight_number_taken"],
        11: ["invalid_date"],
        12: ["arrival_not_after_departure"],
        13: ["arrival_not_after_departure"],
        14: [],
        15: ["flight_number_taken"],
        16: ["flight_number_taken"],
        17: [],
        18: ["invalid_number"],
        19: [],
        20: ["invalid_number"],
        21: ["invalid_number"],
        22: ["invalid_number"],
        23: ["invalid_number"],
        24: [],
    }
    accepted = {r.request_id: r for r in outcome.accepted.collect()}
    assert accepted[14].business_price == Decimal("50.00") and accepted[14].first_class_price == Decimal("66.66")
    assert accepted[17].business_price == Decimal("70.00") and accepted[17].status == "boarding"
    assert accepted[14].aircraft_id == 12 and accepted[14].status == "scheduled"
    assert accepted[14].arrival_datetime == ts("2001-08-01 12:00:00")
    assert accepted[19].business_price == 0
    assert accepted[24].business_price == Decimal("50.00")
