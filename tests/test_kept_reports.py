"""Cells kept by feeds: equal to cells of the new tables, whatever the batch holds."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rows import frame, one, table
from tarmac.operators import kept_reports, reports
from tarmac.operators.booking_changes import apply_changes, decide_changes

CHANGE = (
    "change_id BIGINT, change_ts TIMESTAMP_NTZ, booking_id BIGINT, requester_id BIGINT, op STRING, status STRING, "
    "payment_status STRING"
)


def rows(df):
    return sorted(repr(tuple(r)) for r in df.select(kept_reports.CELL_COLUMNS).collect())


def bookings(spark, count, seed=1):
    rng = random.Random(seed)
    return table(
        spark,
        "bookings",
        *[
            dict(
                booking_id=i,
                user_id=i,
                flight_id=rng.choice([None, 1, 1, 1, 2]),
                booking_date=rng.choice([None, datetime(2001, 6, 30, 23, 59, 59), datetime(2001, 7, 1)]),
                total_amount=rng.choice([None, 0, 10.5]),
                status=rng.choice(["confirmed", "confirmed", "cancelled", "pending", None]),
                payment_status=rng.choice(["paid", None]),
                **{"class": rng.choice([None, "first", "economy"])},
            )
            for i in range(count)
        ],
    )


def links(spark, count, seed=2):
    rng = random.Random(seed)
    return table(spark, "booking_passengers", *[dict(booking_id=i) for i in range(count) for _ in range(rng.randrange(4))])


def changes(spark, count, on, seed=3):
    rng = random.Random(seed)
    made = []
    for i in range(count):
        b = 0 if rng.random() < 0.3 else rng.randrange(on)
        op = rng.choice(["cancel", "admin_status"])
        at = datetime(2001, 7, 1) + timedelta(seconds=rng.randrange(50))
        status = rng.choice(["pending", "confirmed", "cancelled"]) if op == "admin_status" else None
        made.append(dict(change_id=i, change_ts=at, booking_id=b, requester_id=b, op=op, status=status))
    return frame(spark, CHANGE, made)


def test_batches_of_changes_give_the_cells_of_the_new_table(spark):
    before, seats = bookings(spark, 60), links(spark, 60)
    cells = kept_reports.cells_of(before, seats)
    for seed in (3, 4):
        accepted = decide_changes(before, changes(spark, 150, 60, seed)).stored("changes").accepted
        cells = kept_reports.merged(cells, kept_reports.cells_of_changes(before, seats, accepted))
        before = apply_changes(before, accepted)
        assert rows(cells) == rows(kept_reports.cells_of(before, seats))


def test_change_and_back_leaves_nothing(spark):
    given = table(spark, "bookings", dict(booking_id=1, user_id=1, flight_id=1, status="confirmed", payment_status="paid"))
    there_and_back = [
        dict(change_id=i, change_ts="2001-07-01T00:00:00", booking_id=1, op="admin_status", status=s)
        for i, s in enumerate(["pending", "confirmed"])
    ]
    accepted = decide_changes(given, frame(spark, CHANGE, there_and_back)).stored("changes").accepted
    assert accepted.count() == 2
    assert rows(kept_reports.cells_of_changes(given, links(spark, 2), accepted)) == []


def test_new_bookings_and_order_of_batches(spark):
    old, new = bookings(spark, 20), bookings(spark, 9, seed=8).withColumn("booking_id", F.col("booking_id") + 1000)
    seats = links(spark, 20)
    parts = [kept_reports.cells_of(old, seats), kept_reports.cells_of(new, seats)]
    assert rows(kept_reports.merged(*parts)) == rows(kept_reports.merged(*parts[::-1]))
    assert rows(kept_reports.merged(*parts)) == rows(kept_reports.cells_of(old.unionByName(new), seats))


def test_empty_tables(spark):
    nothing = kept_reports.cells_of(table(spark, "bookings"), table(spark, "booking_passengers"))
    assert rows(nothing) == []
    flights, aircraft, airports = (table(spark, t) for t in ("flights", "aircraft", "airports"))
    got = one(kept_reports.overview(nothing, flights, aircraft, airports, "2001-07-15"))
    of_tables = reports.overview(
        table(spark, "bookings"), table(spark, "booking_passengers"), flights, aircraft, airports, "2001-07-15"
    )
    assert got == one(of_tables)
    assert one(kept_reports.bookings_report(nothing, "2001-07-15"))["total_bookings"] == 0
    assert one(kept_reports.revenue_report(nothing, flights, airports, "2001-07-15"))["revenue_trend"] == []
    assert one(kept_reports.routes_report(nothing, flights, airports))["popular_routes"] == []


def test_reports_equal_those_of_the_tables(spark):
    made, seats = bookings(spark, 80), links(spark, 80)
    flights = table(
        spark,
        "flights",
        *[dict(flight_id=f, aircraft_id=1, from_airport_code="A", to_airport_code=to, status="scheduled", base_price=5) for f, to in ((1, "B"), (2, "C"))],
    )
    airports = table(spark, "airports", *[dict(airport_code=c, city=f"C{c}", airport_name=c) for c in "ABC"])
    aircraft = table(spark, "aircraft", dict(aircraft_id=1, capacity=50))
    cells = kept_reports.cells_of(made, seats)
    day = "2001-07-15"
    assert one(kept_reports.overview(cells, flights, aircraft, airports, day)) == one(
        reports.overview(made, seats, flights, aircraft, airports, day)
    )
    assert one(kept_reports.revenue_report(cells, flights, airports, day)) == one(
        reports.revenue_report(made, flights, airports, day)
    )
    assert one(kept_reports.bookings_report(cells, day)) == one(reports.bookings_report(made, day))
    assert one(kept_reports.routes_report(cells, flights, airports)) == one(reports.routes_report(made, flights, airports))
