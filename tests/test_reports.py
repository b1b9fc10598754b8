"""Golden rows for the edges of the reports."""

from decimal import Decimal

import pytest

from rows import one, table
from tarmac.functions.expr import growth_pct, hours_and_minutes, lenient_int, pct_round, route_name
from tarmac.operators import reports
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def empty(spark):
    return {n: table(spark, n) for n in ("bookings", "flights", "aircraft", "airports", "booking_passengers", "users")}


def booking(i, **columns):
    return {"booking_id": i, "status": "confirmed", "payment_status": "paid", **columns}


def test_empty_tables_give_zeros(empty):
    e = empty
    assert one(reports.total_revenue(e["bookings"])) == {"total": Decimal("0.00")}
    assert one(reports.on_time_rate(e["flights"])) == {"on_time_rate": 0}
    occupancy = reports.occupancy_all_flights(e["bookings"], e["booking_passengers"], e["flights"], e["aircraft"])
    assert one(occupancy) == {"rate": 0, "booked": 0, "total": 0}
    assert one(reports.avg_flight_time(e["flights"]))["avg_flight_time"] == "0h 0m"
    assert one(reports.revenue_growth(e["bookings"], "2001-07-15"))["growth"] == 0.0
    overview = one(
        reports.overview(
            e["bookings"], e["booking_passengers"], e["flights"], e["aircraft"], e["airports"], "2001-07-15"
        )
    )
    assert overview["popular_routes"] == [] and overview["bookings_total"] == 0
    assert one(reports.admin_stats(e["users"], e["flights"], e["bookings"], e["aircraft"]))["total_users"] == 0
    report = one(reports.bookings_report(e["bookings"], "2001-07-15"))
    assert report["booking_trend"] == [] and report["growth"] == 0.0
    hot = reports.hot_flights(
        e["bookings"], e["booking_passengers"], e["flights"], e["aircraft"], e["airports"], "2001-07-15"
    )
    assert hot.collect() == []


def test_month_end_clock(spark):
    """31 March: the previous month is February, six months back is 30 September."""
    dates = ["2001-02-01 00:00", "2001-02-28 23:59:59.999", "2001-03-01 00:00", "2001-03-31 23:59", "2000-09-30 00:00"]
    rows = [booking(i, booking_date=d, total_amount=10) for i, d in enumerate(dates)]
    late = booking(9, booking_date="2000-09-29 23:59:59", total_amount=10)
    future = booking(10, booking_date="2001-04-01 00:00", total_amount=10)
    bookings = table(spark, "bookings", *rows, late, future)
    assert one(reports.booking_growth(bookings, "2001-03-31")) == {"current": 2, "previous": 2, "growth": 0.0}
    months = {r["month"]: r["count"] for r in reports.booking_trend(bookings, "2001-03-31").collect()}
    assert months == {"2000-09": 1, "2001-02": 2, "2001-03": 2, "2001-04": 1}


def test_january_looks_back_a_year(spark):
    bookings = table(
        spark,
        "bookings",
        booking(1, booking_date="2000-12-31 10:00", total_amount=50),
        booking(2, booking_date="2001-01-01 00:00", total_amount=75),
    )
    growth = one(reports.revenue_growth(bookings, "2001-01-31"))
    assert growth == {"current": Decimal("75.00"), "previous": Decimal("50.00"), "growth": 50.0}


def test_null_status_is_not_booked(spark):
    flights = table(spark, "flights", {"flight_id": 1, "aircraft_id": 1, "status": "cancelled"})
    aircraft = table(spark, "aircraft", {"aircraft_id": 1, "capacity": 4})
    bookings = table(spark, "bookings", {"booking_id": 1, "flight_id": 1}, {"booking_id": 2, "status": "missed"})
    people = table(spark, "booking_passengers", *[{"booking_id": b} for b in (1, 1, 2, 3)])
    assert one(reports.occupancy_all_flights(bookings, people, flights, aircraft)) == {
        "rate": 25,
        "booked": 1,
        "total": 4,
    }
    # no flight counts, but the booked seats still do
    assert one(reports.occupancy_active_flights(bookings, people, flights, aircraft)) == {
        "rate": 0,
        "booked": 1,
        "total": 0,
    }


def test_two_on_time_definitions(spark):
    states = ["scheduled", "boarding", "completed", "delayed", "cancelled", "cancelled", "diverted"]
    flights = table(spark, "flights", *[{"flight_id": i, "status": s} for i, s in enumerate(states)])
    assert one(reports.on_time_rate(flights)) == {"on_time_rate": 75}
    assert one(reports.on_time_performance(flights)) == {
        "rate": 50,
        "on_time": 3,
        "delayed": 1,
        "cancelled": 2,
        "total": 6,
    }


@pytest.fixture(scope="module")
def network(spark):
    airports = table(
        spark,
        "airports",
        {"airport_code": "AAA", "airport_name": "A one", "city": "Alpha", "country": "X"},
        {"airport_code": "AAB", "airport_name": "A two", "city": "Alpha", "country": "X"},
        {"airport_code": "BBB", "airport_name": "B", "city": "Beta", "country": "X"},
    )
    ends = [("AAA", "BBB"), ("AAB", "BBB"), ("BBB", "AAA"), ("AAA", "ZZZ")]
    flights = table(
        spark,
        "flights",
        *[
            {
                "flight_id": i,
                "aircraft_id": 1,
                "from_airport_code": a,
                "to_airport_code": b,
                "base_price": 100,
                "business_price": None if i == 0 else 250,
                "first_class_price": 400,
                "departure_datetime": "2001-07-20 10:00",
                "arrival_datetime": "2001-07-20 11:00",
                "status": "scheduled",
            }
            for i, (a, b) in enumerate(ends)
        ],
    )
    return flights, airports


def test_routes_merge_by_city_and_split_by_airport(spark, network):
    flights, airports = network
    bookings = table(spark, "bookings", *[booking(i, flight_id=i % 4) for i in range(8)])
    by_city = reports.popular_routes_city(bookings, flights, airports).collect()
    assert [(r.route, r.booking_count) for r in by_city] == [("Alpha → Beta", 4), ("Beta → Alpha", 2)]
    by_airport = reports.popular_routes_airport(bookings, flights, airports).collect()
    assert [(r.from_code, r.to_code) for r in by_airport] == [("AAA", "BBB"), ("AAB", "BBB"), ("BBB", "AAA")]


def test_average_list_price(spark, network):
    """Null prices do not count; an unknown class pays the base price."""
    flights, airports = network
    classes = [(0, "business"), (0, "cargo"), (0, None), (1, "first"), (2, "business")]
    bookings = table(spark, "bookings", *[booking(i, flight_id=f, **{"class": c}) for i, (f, c) in enumerate(classes)])
    prices = {r.route: r.avg_price for r in reports.route_avg_price(bookings, flights, airports).collect()}
    assert prices == {"Beta → Alpha": 250.0, "Alpha → Beta": 200.0}
    nothing = table(spark, "bookings", booking(1, flight_id=0, **{"class": "business"}))
    assert [r.avg_price for r in reports.route_avg_price(nothing, flights, airports).collect()] == [None]


def test_hot_flights_counts_both_ways(spark, network):
    flights, airports = network
    aircraft = table(spark, "aircraft", {"aircraft_id": 1, "model": "M", "capacity": 3})
    bookings = table(
        spark,
        "bookings",
        booking(1, flight_id=1, total_amount=10),
        booking(2, flight_id=2, total_amount=30),
        {"booking_id": 3, "flight_id": 1, "status": "pending"},
        {"booking_id": 4, "flight_id": 1, "status": "cancelled"},
    )
    people = table(spark, "booking_passengers", *[{"booking_id": b} for b in (1, 3, 3, 3, 4, 2)])
    rows = reports.hot_flights(bookings, people, flights, aircraft, airports, "2001-07-20").collect()
    got = [(r.flight_id, r.booking_count, r.total_revenue, r.booked_seats, r.occupancy_rate) for r in rows]
    assert got == [(2, 1, 30, 1, 33), (1, 1, 10, 4, 133), (0, 0, 0, 0, 0)]
    assert reports.hot_flights(bookings, people, flights, aircraft, airports, "2001-07-21").collect() == []


def test_scalar_helpers(spark):
    row = (
        spark.range(1)
        .select(
            pct_round(F.lit(1), F.lit(8)).alias("half_up"),
            pct_round(F.lit(1), F.lit(0)).alias("by_zero"),
            growth_pct(F.lit(5), F.lit(-1)).alias("no_growth"),
            growth_pct(F.lit(2), F.lit(3)).alias("shrunk"),
            hours_and_minutes(F.lit(119.7)).alias("rolls_over"),
            lenient_int(F.lit(" 12abc")).alias("lenient"),
            lenient_int(F.lit("abc")).alias("not_a_number"),
            lenient_int(F.lit("99999999999999999999")).alias("too_long"),
            route_name(F.lit("A"), F.lit(None).cast("string")).alias("no_city"),
        )
        .first()
    )
    assert row.asDict() == {
        "half_up": 13,
        "by_zero": 0,
        "no_growth": 0.0,
        "shrunk": -33.3,
        "rolls_over": "1h 60m",
        "lenient": 12,
        "not_a_number": None,
        "too_long": None,
        "no_city": None,
    }
