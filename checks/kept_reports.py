"""Reports from cells that two feeds keep up to date, against the same reports over the tables after both."""

import re

from pyspark.sql import functions as F

from checks import WRITTEN, check, text
from checks.changes import WALK
from checks.requests import FIRST_BOOKING, FIRST_LINK, FIRST_PASSENGER, NESTED, NESTED_TABLES, _nested
from fixtures import AS_OF
from tarmac.operators import admission, booking_changes, kept_reports
from tarmac.sources.work import stored

TABLES = f"{NESTED_TABLES} booking_changes airports"


def renamed(sql: str, **names: str) -> str:
    """``sql`` with whole names replaced."""
    return re.sub(rf"\b({'|'.join(names)})\b", lambda m: names[m.group()], sql)


# Admissions and changes are both decided on the tables as they were.
AFTER = f"""{renamed(NESTED, q='asked_in_turn', walk='admitted')}, {WALK},
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY booking_id ORDER BY place DESC) = 1),
bookings_after AS (SELECT b.booking_id, b.flight_id, b.booking_date, b.class, b.total_amount,
CASE WHEN l.booking_id IS NULL THEN b.status ELSE l.status END AS status,
CASE WHEN l.booking_id IS NULL THEN b.payment_status ELSE l.payment_status END AS payment_status
FROM bookings b LEFT JOIN last l ON l.booking_id = b.booking_id
UNION ALL SELECT {FIRST_BOOKING} + request_id, flight_id, request_ts, class, amount, 'confirmed', 'paid' FROM won),
passengers_after AS (SELECT booking_id FROM booking_passengers UNION ALL SELECT {FIRST_BOOKING} + request_id FROM people)"""


def after(report: str) -> str:
    return f"WITH RECURSIVE {AFTER} {renamed(WRITTEN[report], bookings='bookings_after', booking_passengers='passengers_after')}"


def _kept(requests, flights, aircraft, bookings, booking_passengers, changes):
    """Cells of the tables, and after both feeds."""
    before = stored(kept_reports.cells_of(bookings, booking_passengers), "cells")
    admitted = _nested(requests, flights, aircraft, bookings, booking_passengers).accepted
    decided = booking_changes.decide_changes(bookings, changes).stored("booking-changes")
    return kept_reports.merged(
        before,
        kept_reports.cells_of(
            admission.booking_rows(admitted, FIRST_BOOKING),
            admission.link_rows(admitted, FIRST_BOOKING, FIRST_PASSENGER, FIRST_LINK),
        ),
        kept_reports.cells_of_changes(bookings, booking_passengers, decided.accepted),
    )


def _stored(*given):
    return stored(_kept(*given), "cells-after")


@check(
    TABLES,
    f"""WITH RECURSIVE {AFTER}, party AS (SELECT booking_id, count(*) AS k FROM passengers_after GROUP BY booking_id),
c AS (SELECT a.*, CAST(booking_date AS DATE) AS booked_on, coalesce(k, 0) AS k FROM bookings_after a LEFT JOIN party s ON s.booking_id = a.booking_id)
SELECT 'flight' AS grain, flight_id, class, CAST(NULL AS DATE) AS booked_on, status, payment_status, count(*) AS n,
CAST(sum(total_amount) AS DECIMAL(38,2)) AS amount, CAST(sum(k) AS BIGINT) AS seats FROM c GROUP BY flight_id, class, status, payment_status
UNION ALL SELECT 'day', NULL, NULL, booked_on, status, payment_status, count(*), CAST(sum(total_amount) AS DECIMAL(38,2)), CAST(sum(k) AS BIGINT)
FROM c GROUP BY booked_on, status, payment_status""",
)
def kept_cells(*given):
    return _kept(*given[:-1])


@check(TABLES, after("overview"))
def kept_overview(*given):
    flights, aircraft, airports = given[1], given[2], given[-1]
    df = kept_reports.overview(_stored(*given[:-1]), flights, aircraft, airports, AS_OF)
    return df.withColumn("popular_routes", text("popular_routes", "route", "booking_count"))


@check(TABLES, after("revenue_report"))
def kept_revenue_report(*given):
    df = kept_reports.revenue_report(_stored(*given[:-1]), given[1], given[-1], AS_OF)
    return df.withColumns(
        {
            "revenue_by_route": text("revenue_by_route", "route", "revenue"),
            "revenue_trend": text("revenue_trend", "month", "revenue"),
        }
    )


@check(TABLES, after("bookings_report"))
def kept_bookings_report(*given):
    df = kept_reports.bookings_report(_stored(*given[:-1]), AS_OF)
    return df.withColumns(
        {
            "booking_status": text("booking_status", "status", "count"),
            "booking_trend": text("booking_trend", "month", "count"),
        }
    )


@check(TABLES, after("routes_report"))
def kept_routes_report(*given):
    df = kept_reports.routes_report(_stored(*given[:-1]), given[1], given[-1])
    in_mills = F.transform(
        "route_performance",
        lambda x: F.struct(x["route"], F.floor(x["avg_price"] * 1000).alias("avg_price_mills")),
    )
    return df.withColumn("route_performance", in_mills).withColumns(
        {
            "popular_routes": text("popular_routes", "route", "from_code", "to_code", "booking_count"),
            "route_performance": text("route_performance", "route", "avg_price_mills"),
            "route_revenue": text("route_revenue", "route", "revenue"),
        }
    )
