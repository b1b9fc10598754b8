"""Listings: parameters, ties, paging, nesting."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rows import one, table
from tarmac.operators import listings
from tarmac.plans import paging


@pytest.fixture(scope="module")
def airline(spark):
    airports = table(
        spark,
        "airports",
        {"airport_code": "AAA", "airport_name": "Alpha_Field", "city": "Alpha", "country": "X"},
        {"airport_code": "BBB", "airport_name": "100% Beta", "city": "Beta", "country": "Y"},
    )
    aircraft = table(spark, "aircraft", {"aircraft_id": 1, "model": "M", "capacity": 3})
    rows = [
        (1, "F1", "AAA", "BBB", "2001-07-20 23:59:59.999", "scheduled", 1),
        (2, "F2", "AAA", "BBB", "2001-07-21 00:00:00", "boarding", 1),
        (3, "F3", "BBB", "AAA", "2001-07-20 00:00:00", "scheduled", 1),
        (4, "F4", "AAA", "BBB", "2001-07-20 10:00:00", "delayed", 1),
        (5, "F3", "BBB", "AAA", "2001-07-22 00:00:00", "completed", 1),
        (6, "F6", "AAA", "BBB", "2001-07-20 12:00:00", "scheduled", 99),
    ]
    flights = table(
        spark,
        "flights",
        *[
            {
                "flight_id": i,
                "flight_number": n,
                "from_airport_code": a,
                "to_airport_code": b,
                "departure_datetime": d,
                "status": s,
                "aircraft_id": plane,
                "base_price": 100,
                "business_price": None if i == 1 else 150,
                "first_class_price": 200,
            }
            for i, n, a, b, d, s, plane in rows
        ],
    )
    bookings = table(
        spark,
        "bookings",
        {"booking_id": 1, "user_id": 7, "flight_id": 1, "status": "confirmed", "booking_date": "2001-07-01 10:00"},
        {"booking_id": 2, "user_id": 7, "flight_id": 1, "status": "cancelled", "booking_date": "2001-07-02 10:00"},
        {"booking_id": 3, "user_id": 8, "flight_id": 2, "status": "pending", "booking_date": "2001-07-03 10:00"},
    )
    people = table(
        spark,
        "booking_passengers",
        *[
            {"booking_passenger_id": 10 + i, "booking_id": b, "passenger_id": p, "seat_number": f"{i}A"}
            for i, (b, p) in enumerate([(1, 1), (1, 2), (1, 1), (1, 3), (2, 1)])
        ],
    )
    passengers = table(
        spark,
        "passengers",
        *[{"passenger_id": i, "user_id": 7, "first_name": f"P{i}", "last_name": "L", "is_saved": i % 2} for i in (1, 2, 3)],
    )
    users = table(
        spark,
        "users",
        {"user_id": 7, "first_name": "U", "last_name": "Seven", "email": "u@x.y", "status": "active", "role": "user"},
        {"user_id": 8, "status": "suspended", "role": "user"},
    )
    return {
        "airports": airports,
        "aircraft": aircraft,
        "flights": flights,
        "bookings": bookings,
        "people": people,
        "passengers": passengers,
        "users": users,
    }


def search(a, **parameters):
    df = listings.flight_search(a["flights"], a["airports"], a["aircraft"], a["bookings"], a["people"], **parameters)
    return df.collect()


def test_search_orders_and_never_goes_below_zero(airline):
    rows = search(airline)
    assert [r.flight_id for r in rows] == [3, 1, 2]
    assert {r.flight_id: r.available_seats for r in rows} == {1: 0, 2: 3, 3: 3}


def test_search_filters(airline):
    assert [r.flight_id for r in search(airline, from_code="AAA", departure="2001-07-20")] == [1]
    assert [r.flight_id for r in search(airline, to_code="AAA")] == [3]
    assert search(airline, from_code="ZZZ") == []


def test_search_prices(airline):
    business = {r.flight_id: r.total_price for r in search(airline, flight_class="business", passengers="2x")}
    assert business == {1: None, 2: Decimal("300.00"), 3: Decimal("300.00")}
    assert {r.price for r in search(airline, flight_class="cargo")} == {Decimal("100.00")}
    assert {r.total_price for r in search(airline, passengers="many")} == {None}


def test_flight_detail_of_any_status(airline):
    a = airline
    row = one(listings.flight_detail(a["flights"], a["airports"], a["aircraft"], a["bookings"], a["people"], 4))
    assert (row["status"], row["available_seats"], row["from_country"]) == ("delayed", 3, "X")


def test_flight_status_takes_the_lowest_id(airline):
    a = airline
    assert one(listings.flight_status(a["flights"], a["airports"], a["aircraft"], "F3"))["flight_id"] == 3
    assert listings.flight_status(a["flights"], a["airports"], a["aircraft"], "F9").collect() == []


def page(a, **parameters):
    df = listings.admin_flights_page(a["flights"], a["airports"], a["aircraft"], **parameters)
    return [r.flight_id for r in df.collect()]


def test_pages(airline):
    assert page(airline) == [5, 2, 1, 4, 3]
    assert page(airline, page=2, limit=2) == [1, 4]
    assert page(airline, page=9, limit=2) == []
    assert listings.page_bounds(0, 0) == (1, 50)
    assert listings.page_bounds(-3, -3) == (1, 1)
    assert listings.page_bounds(2, 1000) == (2, 100)


def test_deep_pages_are_the_same(spark):
    """Pages found by counting equal pages read off the sorted list, with ties, microseconds and nulls."""
    rng = random.Random(1)
    times = [None, *(f"2001-07-{d:02d} 10:00:{s:02d}.{u:06d}" for d in (1, 2) for s in (0, 59) for u in (0, 1, 999999))]
    rows = [{"flight_id": i, "departure_datetime": rng.choice(times)} for i in range(400)]
    df = table(spark, "flights", *rows).select("flight_id", "departure_datetime")
    order = [F.desc("departure_datetime"), F.asc("flight_id")]
    buckets = [*paging.latest_first("departure_datetime"), F.floor(F.col("flight_id") / 16)]
    expected = [r.flight_id for r in df.orderBy(*order).collect()]
    for offset, limit in [(0, 10), (37, 50), (195, 3), (390, 50), (400, 5)]:
        got = paging.deep_page(df, order, buckets, offset, limit).orderBy(*order).collect()
        assert [r.flight_id for r in got] == expected[offset : offset + limit]
    got = paging.page(df, order, buckets, 100, 20).collect()
    assert [r.flight_id for r in got] == expected[100:120]


def test_search_text_is_literal(airline):
    assert len(page(airline, search="%")) == 5
    assert page(airline, search="0%") == page(airline, search="100% beta")
    assert len(page(airline, search="A_F")) == 5
    assert page(airline, search="l%a") == []
    assert page(airline, search=" f4 ") == [4]


def test_totals_count_flights_without_aircraft(airline):
    totals = one(listings.admin_flights_total(airline["flights"], airline["airports"], limit=5))
    assert totals == {"page": 1, "limit": 5, "total": 6, "total_pages": 2}


def test_bookings_of_a_user(airline):
    a = airline
    rows = listings.user_bookings(a["bookings"], a["flights"], a["airports"], 7).collect()
    assert [r.booking_id for r in rows] == [2, 1]
    assert rows[0].from_city == "Alpha" and rows[0].flight_status == "scheduled"
    only = listings.user_bookings(a["bookings"], a["flights"], a["airports"], 7, "cancelled").collect()
    assert [r.booking_id for r in only] == [2]
    everyone = listings.admin_bookings(a["bookings"], a["users"], a["flights"], a["airports"], "all").collect()
    assert [r.booking_id for r in everyone] == [3, 2, 1]


def test_booking_with_nested_passengers(airline):
    a = airline
    detail = listings.booking_detail(a["bookings"], a["flights"], a["airports"])
    rows = listings.booking_with_passengers(detail, a["people"], a["passengers"]).collect()
    nested = {r.booking_id: [(p.passenger_id, p.seat_number) for p in r.passengers] for r in rows}
    assert nested == {1: [(1, "0A"), (2, "1A"), (1, "2A"), (3, "3A")], 2: [(1, "4A")], 3: []}
    assert listings.booking_detail(a["bookings"], a["flights"], a["airports"], 1, user_id=8).collect() == []
    flat = listings.booking_passenger_detail(detail, a["people"], a["passengers"]).collect()
    assert sorted(r.booking_id for r in flat) == [1, 1, 1, 1, 2, 3]


def test_bookings_are_cut_in_their_order(airline):
    rows = listings.nested_passengers(airline["people"], airline["passengers"], width=2).collect()
    parts = {(r.booking_id, r.part): [p.seat_number for p in r.passengers] for r in rows}
    assert parts == {(1, 0): ["0A", "1A"], (1, 1): ["2A", "3A"], (2, 0): ["4A"]}


def test_a_very_large_booking_keeps_its_order(spark):
    ids = spark.range(2500)
    links = ids.selectExpr("id AS booking_passenger_id", "1L AS booking_id", "id AS passenger_id", "'' AS seat_number")
    people = table(spark, "passengers", *[{"passenger_id": i, "last_name": f"{9999 - i:05d}"} for i in range(2500)])
    rows = listings.nested_passengers(links, people, order=("last_name", "booking_passenger_id")).collect()
    names = [p.last_name for r in sorted(rows, key=lambda r: r.part) for p in r.passengers]
    assert [len(r.passengers) for r in sorted(rows, key=lambda r: r.part)] == [1000, 1000, 500]
    assert names == sorted(names) and len(set(names)) == 2500


def test_narrow_and_wide_bookings_together(spark):
    rng = random.Random(4)
    people = [{"passenger_id": i, "last_name": rng.choice(["a", "b", None])} for i in range(30)] + [{"passenger_id": 3, "last_name": "c"}]
    links = [
        {"booking_passenger_id": i, "booking_id": rng.choice([1, 1, 1, 2, 3, 4, None]), "passenger_id": rng.choice([3, *range(32)]), "seat_number": f"{i}"}
        for i in range(120)
    ]
    expected = {}
    for i in sorted(links, key=lambda i: i["booking_passenger_id"]):
        for p in sorted((p for p in people if p["passenger_id"] == i["passenger_id"]), key=lambda p: p["last_name"] or ""):
            if i["booking_id"] is not None:
                expected.setdefault(i["booking_id"], []).append((i["seat_number"], p["last_name"]))
    for width in (1, 7, 25, 1000):
        rows = listings.nested_passengers(
            table(spark, "booking_passengers", *links), table(spark, "passengers", *people), width=width, order=("booking_passenger_id", "last_name")
        ).collect()
        got = {(r.booking_id, r.part): [(p.seat_number, p.last_name) for p in r.passengers] for r in rows}
        assert len(got) == len(rows)
        assert got == {(b, k // width): x[k : k + width] for b, x in expected.items() for k in range(0, len(x), width)}


def test_nested_passengers_move_once(spark, airline):
    """Behind the join with the passengers, rows lie by booking for the arrays and for the booking they go to."""
    a = airline
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        detail = listings.booking_detail(a["bookings"], a["flights"], a["airports"])
        df = listings.booking_with_passengers(detail, a["people"], a["passengers"])
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"Exchange[^\n]*\n([^\n]*)", text)
    assert sum("last_name" in line for line in moved) == 2  # the passengers themselves, and what they are joined to
    assert "part#" not in " ".join(re.findall(r"Exchange[^\n]*", text)) and "Window" not in text


def test_people(airline):
    assert [r.passenger_id for r in listings.saved_passengers(airline["passengers"], 7).collect()] == [3, 1]
    assert "password" not in listings.users_public(airline["users"]).columns
    active = listings.active_users(airline["bookings"].select("booking_id", "user_id"), airline["users"]).collect()
    assert sorted(r.booking_id for r in active) == [1, 2]
