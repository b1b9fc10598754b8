"""Check-in at the edges of its window, and seats."""

import pytest

from rows import frame, reasons, table, ts
from tarmac.operators import checkin

NOW = "2001-07-30 12:00:00"


@pytest.fixture(scope="module")
def airline(spark):
    departures = {
        1: "2001-07-30 11:59:59.999",
        2: "2001-07-30 12:00:00",
        3: "2001-07-31 12:00:00",
        4: "2001-07-31 12:00:00.001",
        5: "2001-07-31 13:30:00",
    }
    flights = table(
        spark,
        "flights",
        *[
            {"flight_id": f, "departure_datetime": d, "from_airport_code": "A", "to_airport_code": "B"}
            for f, d in departures.items()
        ],
    )
    airports = table(spark, "airports", {"airport_code": "A", "city": "a"}, {"airport_code": "B", "city": "b"})
    rows = [{"booking_id": f, "booking_reference": f"BK00{f}", "user_id": 7, "flight_id": f, "status": "confirmed"} for f in departures]
    rows += [
        {"booking_id": 6, "booking_reference": "BK006", "user_id": 7, "flight_id": 2, "status": "pending"},
        {"booking_id": 7, "booking_reference": "BK007", "user_id": 7, "flight_id": 2, "status": "confirmed"},
        {"booking_id": 8, "booking_reference": "BK008", "user_id": 7, "flight_id": 2, "status": "confirmed"},
        {"booking_id": 9, "booking_reference": "BK009", "user_id": 7, "flight_id": 99, "status": "confirmed"},
    ]
    bookings = table(spark, "bookings", *rows)
    people = table(
        spark,
        "booking_passengers",
        *[{"booking_passenger_id": 10 * b + i, "booking_id": b, "passenger_id": i} for b in range(1, 10) for i in (1, 2)],
    )
    passengers = table(
        spark,
        "passengers",
        {"passenger_id": 1, "first_name": "Zoe", "last_name": "LEE"},
        {"passenger_id": 2, "first_name": "Ann", "last_name": "LEE"},
    )
    check_ins = table(
        spark,
        "check_ins",
        {"check_in_id": 1, "booking_id": 7, "status": "completed"},
        {"check_in_id": 2, "booking_id": 8, "status": "pending"},
    )
    return bookings, flights, airports, people, passengers, check_ins


def test_eligibility(spark, airline):
    bookings, flights, airports, people, passengers, check_ins = airline
    rows = [(i, 7, f"BK00{i}", "lee") for i in range(1, 10)] + [
        (10, 8, "BK002", "lee"),
        (11, 7, "BK002", "smith"),
        (12, 7, "bk002", "lee"),
        (13, 7, "BK2", "lee"),
        (14, 7, " BK002 ", " Lee "),
        (15, 7, "BK002", "L"),
        (16, 7, None, None),
        (17, 7, "BK999", "lee"),
    ]
    ddl = "request_id BIGINT, user_id BIGINT, booking_reference STRING, last_name STRING"
    feed = frame(spark, ddl, [dict(zip(["request_id", "user_id", "booking_reference", "last_name"], r)) for r in rows])
    outcome = checkin.checkin_eligibility(feed, bookings, flights, airports, people, passengers, check_ins, NOW)
    assert reasons(outcome.decided) == {
        1: ["departed"],
        2: [],
        3: [],
        4: ["window_not_open"],
        5: ["window_not_open"],
        6: ["not_confirmed"],
        7: ["already_checked_in"],
        8: [],
        9: ["booking_not_found"],
        10: ["access_denied"],
        11: ["last_name_mismatch"],
        12: ["invalid_request"],
        13: ["invalid_request"],
        14: [],
        15: ["invalid_request"],
        16: ["invalid_request"],
        17: ["booking_not_found"],
    }
    opens = {r.request_id: r.opens_in_hours for r in outcome.decided.collect() if r.opens_in_hours is not None}
    assert opens == {4: 1, 5: 2}
    rows = checkin.eligible_with_passengers(outcome.accepted, people, passengers).collect()
    assert {r.request_id for r in rows} == {2, 3, 8, 14}
    assert all([p.first_name for p in r.passengers] == ["Ann", "Zoe"] for r in rows)
    assert {(r.from_city, r.to_city) for r in rows} == {("a", "b")}


def test_confirmation(spark, airline):
    bookings, flights, _, people, _, check_ins = airline
    ddl = "request_id BIGINT, user_id BIGINT, booking_id BIGINT, seat_numbers ARRAY<STRING>, gate_number STRING"
    two = [" 1a", "1b "]
    rows = [
        (1, 7, 1, two, None),
        (2, 7, 2, ["1a"], None),
        (3, 7, 2, two, " "),
        (4, 7, 2, two, "G1"),
        (5, 7, 2, ["9z"], None),
        (6, 8, 2, two, None),
        (7, 7, 3, two, "G2"),
        (8, 7, 4, two, None),
        (9, 7, 6, two, None),
        (10, 7, 7, two, None),
        (11, 7, 8, two, None),
        (12, 7, 9, two, None),
        (13, 7, 0, [], "x" * 11),
        (14, 7, 3, ["1a", " "], None),
        (15, 7, None, None, None),
        (16, 7, 3, ["1a", None], None),
    ]
    names = ["request_id", "user_id", "booking_id", "seat_numbers", "gate_number"]
    feed = frame(spark, ddl, [dict(zip(names, r, strict=True)) for r in rows])
    outcome = checkin.confirm_checkins(feed, bookings, flights, people, check_ins, NOW)
    assert reasons(outcome.decided) == {
        1: ["departed"],
        2: ["seat_count_mismatch"],
        3: [],
        4: ["already_checked_in"],
        5: ["already_checked_in"],
        6: ["booking_not_found"],
        7: [],
        8: ["window_not_open"],
        9: ["booking_not_found"],
        10: ["already_checked_in"],
        11: ["already_checked_in"],
        12: ["flight_not_found"],
        13: ["booking_id_invalid", "seat_numbers_required", "gate_number_length"],
        14: ["seat_number_blank"],
        15: ["booking_id_invalid", "seat_numbers_required"],
        16: ["seat_number_blank"],
    }
    rows = {r.booking_id: r for r in checkin.check_in_rows(outcome.accepted, 100).collect()}
    assert (rows[2].check_in_id, rows[2].gate_number, rows[2].boarding_time) == (103, "TBA", ts("2001-07-30 11:30:00"))
    assert (rows[3].gate_number, rows[3].status, rows[3].check_in_datetime) == ("G2", "completed", ts(NOW))
    seats = checkin.with_seats(people, checkin.seat_updates(outcome.accepted, people)).collect()
    assert {r.booking_passenger_id: r.seat_number for r in seats if r.seat_number} == {21: "1A", 22: "1B", 31: "1A", 32: "1B"}
    assert len(seats) == people.count()
