"""Pages by the directory against plain slices of the sorted rows."""

import random
from datetime import datetime

import pytest

from rows import table
from tarmac.operators import listings


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    rng = random.Random(5)
    times = [None, None, datetime(2001, 7, 1), datetime(2001, 7, 1, 0, 0, 1), datetime(2001, 7, 2)]
    rows = [
        dict(
            flight_id=i,
            flight_number=f"F{i}",
            aircraft_id=1 if i % 9 else 2,
            from_airport_code="A",
            to_airport_code="B",
            departure_datetime=rng.choice(times),
        )
        for i in range(130)
    ]
    rng.shuffle(rows)
    path = str(tmp_path_factory.mktemp("pages") / "flights")
    table(spark, "flights", *rows).write.parquet(path)
    airports = table(spark, "airports", *[dict(airport_code=c, city=c, airport_name=c) for c in "AB"])
    return rows, spark.read.parquet(path), airports, table(spark, "aircraft", dict(aircraft_id=1, capacity=9, model="m"))


def test_every_page_is_the_slice_of_the_sorted_rows(given):
    rows, flights, airports, aircraft = given
    rows = [r for r in rows if r["aircraft_id"] == 1]
    rows.sort(key=lambda r: (r["departure_datetime"] is None, -(r["departure_datetime"] or datetime.min).timestamp() if r["departure_datetime"] else 0, r["flight_id"]))
    pages = listings.flight_page_directory(flights, airports, aircraft, limit=25).cache()
    assert {r.page: r.row_count for r in pages.collect()} == {1: 25, 2: 25, 3: 25, 4: 25, 5: len(rows) - 100}
    for page in range(1, 7):
        got = listings.flights_of_page(pages, flights, airports, aircraft, page=page)
        assert [r.flight_id for r in got.collect()] == [r["flight_id"] for r in rows[25 * page - 25 : 25 * page]]


def test_a_page_reaches_the_scan(given):
    _, flights, airports, aircraft = given
    pages = listings.flight_page_directory(flights, airports, aircraft, limit=10)
    page = listings.flights_of_page(pages, flights, airports, aircraft, page=2)
    pushed = page._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(departure_datetime" in pushed and "GreaterThanOrEqual(departure_datetime" in pushed


def test_no_flights(spark, given):
    _, _, airports, aircraft = given
    pages = listings.flight_page_directory(table(spark, "flights"), airports, aircraft)
    assert pages.collect() == []
    assert listings.flights_of_page(pages, table(spark, "flights"), airports, aircraft).collect() == []
