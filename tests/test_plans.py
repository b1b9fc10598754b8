"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as contract
import checks
from tarmac.operators import reports
from tarmac.schemas import TABLES
from tarmac.sources.tables import load_tables
from rows import table

SMALL = "/root/testdata/sf0.001"
# These run jobs of their own before they return a plan.
LAZY = [n for n in checks.QUERIES if not n.endswith(("_stream", "_arrivals", "_tables", "_snapshot", "_bucketed"))]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    for name in TABLES:
        table(spark, name).write.parquet(str(root / name))
    return load_tables(spark, str(root))


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_window_over_everything(spark, name):
    text = plan(contract.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # one partition only ever holds partial totals
    for line in re.findall(r"Exchange SinglePartition.*\n.*", text):
        assert re.search(r"HashAggregate|ObjectHashAggregate|SortAggregate|Union", line), line


def test_month_filter_reaches_the_scan(stored):
    text = plan(reports.monthly_revenue(stored["bookings"], "2001-07-15"))
    assert "GreaterThanOrEqual(booking_date,2001-07-01T00:00)" in text
    assert "LessThan(booking_date,2001-08-01T00:00)" in text
    assert "EqualTo(status,confirmed)" in text
    assert re.search(r"ReadSchema: struct<booking_date:timestamp_ntz,total_amount:decimal\(12,2\),status:string,payment_status:string>", text)


def test_departure_day_reaches_the_scan(spark, stored):
    from tarmac.operators.listings import flight_search

    s = stored
    df = flight_search(
        s["flights"], s["airports"], s["aircraft"], s["bookings"], s["booking_passengers"], departure="2001-07-20"
    )
    assert "GreaterThanOrEqual(departure_datetime,2001-07-20T00:00)" in plan(df)


def test_facts_are_reduced_before_they_move(stored):
    """Bookings shuffle as partial counts per flight, never as rows."""
    text = plan(reports.popular_routes_city(stored["bookings"], stored["flights"], stored["airports"]))
    moved = re.findall(r"Exchange hashpartitioning\(flight_id[^\n]*\n([^\n]*)", text)
    assert moved and all("HashAggregate" in line and "partial_count" in line for line in moved)


def scans(df, name: str) -> int:
    return len(re.findall(rf"FileScan[^\n]*Location: [^\n\]]*/{name}\]", plan(df)))


def test_reports_read_a_fact_once(spark, stored):
    """Reports that store reduced bookings read that table alone afterwards; the others scan the fact once."""
    spark.conf.set("spark.sql.maxMetadataValueLength", "2000")
    s, as_of = stored, "2001-07-15"
    b, bp, f, ac, ap = (s[t] for t in ("bookings", "booking_passengers", "flights", "aircraft", "airports"))
    try:
        assert scans(reports.bookings_report(b, as_of), "bookings") == 1
        assert scans(reports.revenue_report(b, f, ap, as_of), "bookings") == 0
        assert scans(reports.routes_report(b, f, ap), "bookings") == 0
        performance = reports.performance_report(b, bp, f, ac)
        assert scans(performance, "bookings") == scans(performance, "flights") == scans(performance, "booking_passengers") == 1
        # the bookings that hold seats; the flights of the routes and of the fleet
        overview = reports.overview(b, bp, f, ac, ap, as_of)
        assert scans(overview, "bookings") == 1 and scans(overview, "flights") == 2
    finally:
        spark.conf.unset("spark.sql.maxMetadataValueLength")
