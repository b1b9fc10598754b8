"""Reports."""

from pyspark.sql import functions as F

from checks import check, text
from fixtures import AS_OF, HOT_AS_OF
from tarmac.operators import reports

PAID = "status = 'confirmed' AND payment_status = 'paid'"
MONTH = "booking_date >= DATE '2001-07-01' AND booking_date < DATE '2001-08-01'"
PREVIOUS = "booking_date >= DATE '2001-06-01' AND booking_date < DATE '2001-07-01'"
RECENT = "booking_date >= DATE '2001-01-15'"
ROUTES = """bookings b JOIN flights f ON b.flight_id = f.flight_id
JOIN airports dep ON f.from_airport_code = dep.airport_code JOIN airports arr ON f.to_airport_code = arr.airport_code"""
ROUTE = "dep.city || ' → ' || arr.city"
HELD = "booking_passengers bp JOIN bookings b ON bp.booking_id = b.booking_id WHERE b.status != 'cancelled'"


def money(expr: str, where: str = "TRUE") -> str:
    return f"CAST(coalesce(sum(CASE WHEN {where} THEN {expr} END), 0) AS DECIMAL(38,2))"


def growth(current: str, previous: str) -> str:
    cur, prev = f"CAST({current} AS DOUBLE)", f"CAST({previous} AS DOUBLE)"
    return f"CASE WHEN {prev} > 0 THEN round(({cur} - {prev}) / {prev} * 100, 1) ELSE 0.0e0 END"


def pct(part: str, whole: str) -> str:
    return (
        f"CASE WHEN {whole} > 0 THEN CAST(floor(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100 + 0.5) AS BIGINT) "
        "ELSE CAST(0 AS BIGINT) END"
    )


POPULAR_CITY = f"""SELECT {ROUTE} AS route, count(*) AS booking_count FROM {ROUTES}
WHERE b.status = 'confirmed' GROUP BY dep.city, arr.city ORDER BY booking_count DESC, route LIMIT 3"""
POPULAR_AIRPORT = f"""SELECT {ROUTE} AS route, dep.airport_code AS from_code, arr.airport_code AS to_code, count(*) AS booking_count
FROM {ROUTES} WHERE b.status = 'confirmed' GROUP BY dep.city, arr.city, dep.airport_code, arr.airport_code
ORDER BY booking_count DESC, route, from_code, to_code LIMIT 10"""
PRICE = """CASE b.class WHEN 'economy' THEN f.base_price WHEN 'business' THEN f.business_price
WHEN 'first' THEN f.first_class_price ELSE f.base_price END"""
AVG_PRICE = f"""SELECT {ROUTE} AS route, CAST(sum({PRICE}) AS DOUBLE) / count({PRICE}) AS avg_price
FROM {ROUTES} WHERE b.status = 'confirmed' GROUP BY dep.city, arr.city ORDER BY avg_price DESC, route LIMIT 10"""
REVENUE_TREND = f"""SELECT strftime(booking_date, '%Y-%m') AS month, {money('total_amount')} AS revenue FROM bookings
WHERE {PAID} AND {RECENT} GROUP BY 1"""
BOOKING_TREND = f"SELECT strftime(booking_date, '%Y-%m') AS month, count(*) AS count FROM bookings WHERE {RECENT} GROUP BY 1"
BREAKDOWN = "SELECT status, count(*) AS count FROM bookings GROUP BY status"
ON_TIME = "status IN ('scheduled', 'boarding', 'completed')"
COUNTS = f"""(SELECT count(*) FILTER (WHERE {ON_TIME}) AS on_time, count(*) FILTER (WHERE status = 'delayed') AS delayed,
count(*) FILTER (WHERE status = 'cancelled') AS cancelled FROM flights)"""


def route_revenue_sql(k: int) -> str:
    return f"""SELECT {ROUTE} AS route, {money('b.total_amount')} AS revenue FROM {ROUTES}
WHERE b.status = 'confirmed' AND b.payment_status = 'paid' GROUP BY dep.city, arr.city ORDER BY revenue DESC, route LIMIT {k}"""


def occupancy_sql(flights_where: str) -> str:
    return f"""SELECT {pct('booked', 'total')} AS rate, booked, total FROM (SELECT count(*) AS booked FROM {HELD}) x,
(SELECT CAST(coalesce(sum(a.capacity), 0) AS BIGINT) AS total FROM flights f JOIN aircraft a ON f.aircraft_id = a.aircraft_id
WHERE {flights_where}) y"""


FLIGHT_TIME = f"""SELECT avg_minutes, CAST(CAST(floor(avg_minutes / 60) AS BIGINT) AS VARCHAR) || 'h ' ||
CAST(CAST(floor(avg_minutes % 60 + 0.5) AS BIGINT) AS VARCHAR) || 'm' AS avg_flight_time FROM (
SELECT CAST(sum(date_sub('minute', departure_datetime, arrival_datetime)) AS DOUBLE) / count(*) AS avg_minutes
FROM flights WHERE {ON_TIME}) x"""


def as_text(query: str, fields: list[str], order: str) -> str:
    item = " || '=' || ".join(f"CAST({f} AS VARCHAR)" for f in fields)
    return f"(SELECT string_agg({item}, '; ' ORDER BY {order}) FROM ({query}) t)"


@check("bookings", f"SELECT {money('total_amount')} AS total FROM bookings WHERE {PAID}")
def total_revenue(bookings):
    return reports.total_revenue(bookings)


@check("bookings", f"SELECT {money('total_amount')} AS total FROM bookings WHERE {PAID} AND {MONTH}")
def monthly_revenue(bookings):
    return reports.monthly_revenue(bookings, AS_OF)


@check("bookings", "SELECT count(*) AS total FROM bookings WHERE status = 'confirmed'")
def confirmed_bookings(bookings):
    return reports.confirmed_bookings(bookings)


@check("bookings", f"SELECT count(*) AS total FROM bookings WHERE status = 'confirmed' AND {MONTH}")
def monthly_confirmed_bookings(bookings):
    return reports.monthly_confirmed_bookings(bookings, AS_OF)


@check("bookings flights airports", POPULAR_CITY)
def popular_routes_city(bookings, flights, airports):
    return reports.popular_routes_city(bookings, flights, airports)


@check("flights", f"SELECT {pct('on_time', '(on_time + delayed)')} AS on_time_rate FROM {COUNTS} c")
def on_time_rate(flights):
    return reports.on_time_rate(flights)


@check("bookings booking_passengers flights aircraft", occupancy_sql("TRUE"))
def occupancy_all_flights(bookings, booking_passengers, flights, aircraft):
    return reports.occupancy_all_flights(bookings, booking_passengers, flights, aircraft)


@check(
    "bookings booking_passengers flights aircraft airports",
    f"""SELECT r.*, {as_text(POPULAR_CITY, ['route', 'booking_count'], 'booking_count DESC, route')} AS popular_routes,
(SELECT {pct('on_time', '(on_time + delayed)')} FROM {COUNTS} c) AS on_time_rate,
(SELECT rate FROM ({occupancy_sql('TRUE')}) o) AS occupancy_rate
FROM (SELECT {money('total_amount', PAID)} AS revenue_total, {money('total_amount', f'{PAID} AND {MONTH}')} AS revenue_monthly,
count(*) FILTER (WHERE status = 'confirmed') AS bookings_total,
count(*) FILTER (WHERE status = 'confirmed' AND {MONTH}) AS bookings_monthly FROM bookings) r""",
)
def overview(bookings, booking_passengers, flights, aircraft, airports):
    df = reports.overview(bookings, booking_passengers, flights, aircraft, airports, AS_OF)
    return df.withColumn("popular_routes", text("popular_routes", "route", "booking_count"))


@check("bookings flights airports", route_revenue_sql(5))
def revenue_by_route(bookings, flights, airports):
    return reports.revenue_by_route(bookings, flights, airports)


@check("bookings", REVENUE_TREND)
def revenue_trend(bookings):
    return reports.revenue_trend(bookings, AS_OF)


@check(
    "bookings",
    f"""SELECT current, previous, {growth('current', 'previous')} AS growth FROM (
SELECT {money('total_amount', MONTH)} AS current, {money('total_amount', PREVIOUS)} AS previous FROM bookings WHERE {PAID}) x""",
)
def revenue_growth(bookings):
    return reports.revenue_growth(bookings, AS_OF)


@check(
    "bookings flights airports",
    f"""SELECT total_revenue, monthly_revenue, {growth('monthly_revenue', 'previous')} AS growth,
{as_text(route_revenue_sql(5), ['route', 'revenue'], 'revenue DESC, route')} AS revenue_by_route,
{as_text(REVENUE_TREND, ['month', 'revenue'], 'month')} AS revenue_trend FROM (
SELECT {money('total_amount')} AS total_revenue, {money('total_amount', MONTH)} AS monthly_revenue,
{money('total_amount', PREVIOUS)} AS previous FROM bookings WHERE {PAID}) x""",
)
def revenue_report(bookings, flights, airports):
    df = reports.revenue_report(bookings, flights, airports, AS_OF)
    return df.withColumns(
        {
            "revenue_by_route": text("revenue_by_route", "route", "revenue"),
            "revenue_trend": text("revenue_trend", "month", "revenue"),
        }
    )


@check("bookings", f"SELECT count(*) AS total, count(*) FILTER (WHERE {MONTH}) AS monthly FROM bookings")
def all_bookings_counts(bookings):
    return reports.all_bookings_counts(bookings, AS_OF)


@check("bookings", BREAKDOWN)
def booking_status_breakdown(bookings):
    return reports.booking_status_breakdown(bookings)


@check("bookings", BOOKING_TREND)
def booking_trend(bookings):
    return reports.booking_trend(bookings, AS_OF)


@check(
    "bookings",
    f"""SELECT current, previous, {growth('current', 'previous')} AS growth FROM (
SELECT count(*) FILTER (WHERE {MONTH}) AS current, count(*) FILTER (WHERE {PREVIOUS}) AS previous FROM bookings) x""",
)
def booking_growth(bookings):
    return reports.booking_growth(bookings, AS_OF)


@check(
    "bookings",
    f"""SELECT total_bookings, monthly_bookings, {growth('monthly_bookings', 'previous')} AS growth,
{as_text(BREAKDOWN, ['status', 'count'], 'status')} AS booking_status,
{as_text(BOOKING_TREND, ['month', 'count'], 'month')} AS booking_trend FROM (
SELECT count(*) AS total_bookings, count(*) FILTER (WHERE {MONTH}) AS monthly_bookings,
count(*) FILTER (WHERE {PREVIOUS}) AS previous FROM bookings) x""",
)
def bookings_report(bookings):
    df = reports.bookings_report(bookings, AS_OF)
    return df.withColumns(
        {
            "booking_status": text("booking_status", "status", "count"),
            "booking_trend": text("booking_trend", "month", "count"),
        }
    )


@check("bookings flights airports", POPULAR_AIRPORT)
def popular_routes_airport(bookings, flights, airports):
    return reports.popular_routes_airport(bookings, flights, airports)


@check("bookings flights airports", AVG_PRICE)
def route_avg_price(bookings, flights, airports):
    return reports.route_avg_price(bookings, flights, airports)


@check("bookings flights airports", route_revenue_sql(10))
def route_revenue(bookings, flights, airports):
    return reports.route_revenue(bookings, flights, airports)


@check(
    "bookings flights airports",
    f"""SELECT {as_text(POPULAR_AIRPORT, ['route', 'from_code', 'to_code', 'booking_count'], 'booking_count DESC, route, from_code, to_code')} AS popular_routes,
{as_text(AVG_PRICE, ['route', 'CAST(floor(avg_price * 1000) AS BIGINT)'], 'avg_price DESC, route')} AS route_performance,
{as_text(route_revenue_sql(10), ['route', 'revenue'], 'revenue DESC, route')} AS route_revenue""",
)
def routes_report(bookings, flights, airports):
    df = reports.routes_report(bookings, flights, airports)
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


@check(
    "flights",
    f"""SELECT {pct('on_time', '(on_time + delayed + cancelled)')} AS rate, on_time, delayed, cancelled,
on_time + delayed + cancelled AS total FROM {COUNTS} c""",
)
def on_time_performance(flights):
    return reports.on_time_performance(flights)


@check("bookings booking_passengers flights aircraft", occupancy_sql("f." + ON_TIME))
def occupancy_active_flights(bookings, booking_passengers, flights, aircraft):
    return reports.occupancy_active_flights(bookings, booking_passengers, flights, aircraft)


@check("flights", FLIGHT_TIME)
def avg_flight_time(flights):
    return reports.avg_flight_time(flights)


@check(
    "bookings booking_passengers flights aircraft",
    f"""SELECT {pct('on_time', '(on_time + delayed + cancelled)')} AS on_time_rate, on_time, delayed, cancelled,
on_time + delayed + cancelled AS flights_counted, o.rate AS occupancy_rate, o.booked AS seats_booked, o.total AS seats_total,
t.avg_flight_time FROM {COUNTS} c, ({occupancy_sql('f.' + ON_TIME)}) o, ({FLIGHT_TIME}) t""",
)
def performance_report(bookings, booking_passengers, flights, aircraft):
    return reports.performance_report(bookings, booking_passengers, flights, aircraft)


@check(
    "users flights bookings aircraft",
    f"""SELECT (SELECT count(*) FROM users WHERE role = 'user') AS total_users, (SELECT count(*) FROM flights) AS total_flights,
(SELECT count(*) FROM bookings WHERE status = 'confirmed') AS total_bookings,
(SELECT {money('total_amount')} FROM bookings WHERE {PAID}) AS total_revenue,
(SELECT count(*) FROM bookings WHERE status = 'pending') AS pending_bookings,
(SELECT count(*) FROM aircraft WHERE status = 'active') AS active_aircraft""",
)
def admin_stats(users, flights, bookings, aircraft):
    return reports.admin_stats(users, flights, bookings, aircraft)


@check(
    "bookings booking_passengers flights aircraft airports",
    f"""WITH ranked AS (SELECT f.flight_id, f.flight_number, f.departure_datetime, f.arrival_datetime, f.status, f.base_price,
f.business_price, f.first_class_price, dep.airport_code AS from_code, dep.airport_name AS from_name, dep.city AS from_city,
dep.country AS from_country, arr.airport_code AS to_code, arr.airport_name AS to_name, arr.city AS to_city,
arr.country AS to_country, count(b.booking_id) AS booking_count, {money('b.total_amount')} AS total_revenue,
a.model AS aircraft_model, CAST(a.capacity AS INTEGER) AS capacity
FROM flights f JOIN airports dep ON f.from_airport_code = dep.airport_code JOIN airports arr ON f.to_airport_code = arr.airport_code
JOIN aircraft a ON f.aircraft_id = a.aircraft_id LEFT JOIN bookings b ON f.flight_id = b.flight_id AND b.status = 'confirmed'
WHERE f.departure_datetime >= DATE '{HOT_AS_OF}' GROUP BY ALL ORDER BY booking_count DESC, total_revenue DESC, f.flight_id LIMIT 5)
SELECT r.*, coalesce(s.n, 0) AS booked_seats, {pct('coalesce(s.n, 0)', 'r.capacity')} AS occupancy_rate FROM ranked r
LEFT JOIN (SELECT b.flight_id, count(*) AS n FROM {HELD} GROUP BY b.flight_id) s ON s.flight_id = r.flight_id""",
)
def hot_flights(bookings, booking_passengers, flights, aircraft, airports):
    return reports.hot_flights(bookings, booking_passengers, flights, aircraft, airports, HOT_AS_OF)
