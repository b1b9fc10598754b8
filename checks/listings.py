"""Listings and lookups, for all keys at once."""

from pyspark.sql import functions as F

from checks import check
from checks.reports import HELD
from tarmac.operators import listings
from tarmac.operators.searches import search_flights
from tarmac.operators.text_searches import search_texts
from tarmac.plans import airline
from tarmac.sources.work import stored

SEATS = f"(SELECT b.flight_id, count(*) AS n FROM {HELD} GROUP BY b.flight_id)"
PLACES = """dep.airport_code AS from_code, dep.airport_name AS from_name, dep.city AS from_city, dep.country AS from_country,
arr.airport_code AS to_code, arr.airport_name AS to_name, arr.city AS to_city, arr.country AS to_country"""
NAMES = """dep.airport_name AS from_name, dep.city AS from_city, dep.country AS from_country,
arr.airport_name AS to_name, arr.city AS to_city, arr.country AS to_country"""
JOINS = """JOIN airports dep ON f.from_airport_code = dep.airport_code JOIN airports arr ON f.to_airport_code = arr.airport_code
JOIN aircraft a ON f.aircraft_id = a.aircraft_id"""
AVAILABLE = "greatest(0, a.capacity - coalesce(s.n, 0)) AS available_seats"
BOOKING = "b.*"
ON_FLIGHT = """f.flight_number, f.departure_datetime, f.arrival_datetime, f.status AS flight_status, dep.airport_code AS from_code,
dep.airport_name AS from_name, dep.city AS from_city, arr.airport_code AS to_code, arr.airport_name AS to_name, arr.city AS to_city"""
ROUTED = """JOIN flights f ON b.flight_id = f.flight_id JOIN airports dep ON f.from_airport_code = dep.airport_code
JOIN airports arr ON f.to_airport_code = arr.airport_code"""
USER = "u.first_name AS user_first_name, u.last_name AS user_last_name, u.email AS user_email"
PERSON = "p.passenger_id, p.date_of_birth, p.passport_number, p.nationality"
SEARCH = " OR ".join(
    f"contains(lower({c}), 'city_1')" for c in ("f.flight_number", "dep.city", "dep.airport_name", "arr.city", "arr.airport_name")
)


@check("bookings booking_passengers", f"SELECT flight_id, n AS booked_seats FROM {SEATS} s")
def booked_seats(bookings, booking_passengers):
    return airline.booked_seats(bookings, booking_passengers)


@check(
    "flights",
    """SELECT f.flight_id, c.class, CASE c.class WHEN 'economy' THEN base_price WHEN 'business' THEN business_price
WHEN 'first' THEN first_class_price ELSE base_price END AS price
FROM flights f, (VALUES ('economy'), ('business'), ('first'), ('cargo')) c(class)""",
)
def class_price(flights):
    from tarmac.functions.expr import class_price as price

    classes = F.array(*[F.lit(c) for c in ("economy", "business", "first", "cargo")])
    return flights.withColumn("class", F.explode(classes)).select(
        "flight_id", "class", price(F.col("class")).alias("price")
    )


@check(
    "flights airports aircraft bookings booking_passengers",
    f"""SELECT f.flight_id, f.flight_number, f.departure_datetime, f.arrival_datetime, f.status, f.base_price, f.business_price,
f.first_class_price, f.aircraft_id, a.model AS aircraft_model, CAST(a.capacity AS INTEGER) AS capacity, {PLACES}, f.business_price AS price, {AVAILABLE},
CAST(f.business_price * 3 AS DECIMAL(38,2)) AS total_price FROM flights f {JOINS} LEFT JOIN {SEATS} s ON s.flight_id = f.flight_id
WHERE f.status IN ('scheduled', 'boarding')""",
)
def flight_search(flights, airports, aircraft, bookings, booking_passengers):
    return listings.flight_search(
        flights, airports, aircraft, bookings, booking_passengers, passengers="3 adults", flight_class="business"
    )


@check(
    "search_requests flights airports aircraft bookings booking_passengers",
    f"""WITH priced AS (SELECT flight_id, 'economy' AS class, base_price AS price FROM flights
UNION ALL SELECT flight_id, 'cargo', base_price FROM flights UNION ALL SELECT flight_id, 'business', business_price FROM flights
UNION ALL SELECT flight_id, 'first', first_class_price FROM flights),
taken AS (SELECT * FROM {SEATS}),
ends AS (SELECT airport_code AS code, airport_name AS name, city, country FROM airports)
SELECT r.search_id, f.flight_id, f.flight_number, f.departure_datetime, f.arrival_datetime, f.status, a.model AS aircraft_model,
x.code AS from_code, x.name AS from_name, x.city AS from_city, x.country AS from_country,
y.code AS to_code, y.name AS to_name, y.city AS to_city, y.country AS to_country, p.price,
greatest(0, a.capacity - coalesce(t.n, 0)) AS available_seats,
CAST(p.price * TRY_CAST(nullif(regexp_extract(coalesce(r.passengers, '1'), '^[0-9]+'), '') AS BIGINT) AS DECIMAL(38,2)) AS total_price
FROM search_requests r JOIN flights f ON f.status IN ('scheduled', 'boarding')
AND (coalesce(r.from_code, '') = '' OR r.from_code = f.from_airport_code) AND (coalesce(r.to_code, '') = '' OR r.to_code = f.to_airport_code)
AND (r.departure IS NULL OR r.departure = CAST(f.departure_datetime AS DATE))
JOIN priced p ON p.flight_id = f.flight_id AND p.class = coalesce(r.class, 'economy')
JOIN aircraft a ON a.aircraft_id = f.aircraft_id JOIN ends x ON x.code = f.from_airport_code JOIN ends y ON y.code = f.to_airport_code
LEFT JOIN taken t ON t.flight_id = f.flight_id""",
)
def flight_searches(search_requests, flights, airports, aircraft, bookings, booking_passengers):
    return search_flights(search_requests, flights, airports, aircraft, bookings, booking_passengers)


@check(
    "flights airports aircraft bookings booking_passengers",
    f"""SELECT f.*, a.model AS aircraft_model, CAST(a.capacity AS INTEGER) AS capacity, {PLACES}, {AVAILABLE} FROM flights f {JOINS}
LEFT JOIN {SEATS} s ON s.flight_id = f.flight_id""",
)
def flight_detail(flights, airports, aircraft, bookings, booking_passengers):
    return listings.flight_detail(flights, airports, aircraft, bookings, booking_passengers)


@check(
    "flights airports aircraft",
    f"""SELECT f.*, a.model AS aircraft_model, {NAMES} FROM flights f {JOINS}
WHERE f.flight_id IN (SELECT min(flight_id) FROM flights GROUP BY flight_number)""",
)
def flight_status(flights, airports, aircraft):
    return listings.flight_status(flights, airports, aircraft)


@check(
    "flights airports aircraft",
    f"""SELECT f.*, a.model AS aircraft_model, CAST(a.capacity AS INTEGER) AS capacity, {NAMES} FROM flights f {JOINS}
WHERE {SEARCH} ORDER BY f.departure_datetime DESC, f.flight_id LIMIT 40 OFFSET 80""",
)
def admin_flights_page(flights, airports, aircraft):
    return listings.admin_flights_page(flights, airports, aircraft, page=3, limit=40, search=" city_1 ")


PAGE_ROWS = f"""SELECT f.flight_id, f.departure_datetime AS leaves, row_number() OVER (ORDER BY f.departure_datetime DESC NULLS LAST, f.flight_id) - 1 AS place
FROM flights f {JOINS} WHERE {SEARCH}"""


@check(
    "flights airports aircraft",
    f"""SELECT CAST(place // 40 + 1 AS BIGINT) AS page, count(*) AS row_count, arg_min(leaves, place) AS first_ts, arg_min(flight_id, place) AS first_key,
arg_max(leaves, place) AS last_ts, arg_max(flight_id, place) AS last_key FROM ({PAGE_ROWS}) p GROUP BY 1""",
)
def flight_page_directory(flights, airports, aircraft):
    return listings.flight_page_directory(flights, airports, aircraft, limit=40, search="city_1")


@check(
    "flights airports aircraft",
    f"SELECT flight_id, leaves AS departure_datetime FROM ({PAGE_ROWS}) p WHERE place BETWEEN 80 AND 119",
)
def flights_of_page(flights, airports, aircraft):
    pages = stored(listings.flight_page_directory(flights, airports, aircraft, limit=40, search="city_1"), "pages")
    found = listings.flights_of_page(pages, flights, airports, aircraft, page=3, search="city_1")
    return found.select("flight_id", "departure_datetime")


@check(
    "flights airports",
    f"""SELECT 3 AS page, 40 AS limit, count(*) AS total, CAST(ceil(count(*) / 40) AS BIGINT) AS total_pages
FROM flights f JOIN airports dep ON f.from_airport_code = dep.airport_code
JOIN airports arr ON f.to_airport_code = arr.airport_code WHERE {SEARCH}""",
)
def admin_flights_total(flights, airports):
    return listings.admin_flights_total(flights, airports, page=3, limit=40, search="city_1")


@check(
    "text_searches flights airports",
    """WITH said AS (SELECT f.flight_id, f.flight_number, lower(concat_ws(chr(10), f.flight_number, x.city, x.airport_name, y.city, y.airport_name)) AS words
FROM flights f JOIN airports x ON x.airport_code = f.from_airport_code JOIN airports y ON y.airport_code = f.to_airport_code)
SELECT r.search_id, s.flight_id, s.flight_number FROM text_searches r JOIN said s ON contains(s.words, lower(trim(coalesce(r.search, ''))))""",
)
def flight_text_searches(text_searches, flights, airports):
    return search_texts(text_searches, flights, airports)


@check("bookings flights airports", f"SELECT {BOOKING}, {ON_FLIGHT} FROM bookings b {ROUTED}")
def user_bookings(bookings, flights, airports):
    return listings.user_bookings(bookings, flights, airports, status="all")


@check(
    "bookings users flights airports",
    f"SELECT {BOOKING}, {USER}, {ON_FLIGHT} FROM bookings b {ROUTED} JOIN users u ON b.user_id = u.user_id",
)
def admin_bookings(bookings, users, flights, airports):
    return listings.admin_bookings(bookings, users, flights, airports)


@check(
    "bookings users flights airports booking_passengers passengers",
    f"""SELECT {BOOKING}, {USER}, {ON_FLIGHT}, bp.booking_passenger_id, {PERSON}, p.first_name AS passenger_first_name,
p.last_name AS passenger_last_name, bp.seat_number FROM bookings b {ROUTED}
JOIN users u ON b.user_id = u.user_id LEFT JOIN (booking_passengers bp JOIN passengers p ON bp.passenger_id = p.passenger_id)
ON bp.booking_id = b.booking_id""",
)
def booking_detail(bookings, users, flights, airports, booking_passengers, passengers):
    detail = listings.booking_detail(bookings, flights, airports, users=users)
    return listings.booking_passenger_detail(detail, booking_passengers, passengers)


@check(
    "bookings flights airports booking_passengers passengers",
    f"""SELECT b.booking_id, CAST(0 AS INTEGER) AS part, coalesce(string_agg(CAST(p.passenger_id AS VARCHAR) || '=' || p.last_name, '; '
ORDER BY bp.booking_passenger_id), '') AS passengers FROM bookings b {ROUTED} LEFT JOIN
(booking_passengers bp JOIN passengers p ON bp.passenger_id = p.passenger_id) ON bp.booking_id = b.booking_id GROUP BY b.booking_id""",
)
def booking_with_passengers(bookings, flights, airports, booking_passengers, passengers):
    from checks import text

    detail = listings.booking_detail(bookings, flights, airports)
    nested = listings.booking_with_passengers(detail, booking_passengers, passengers)
    return nested.select("booking_id", "part", text("passengers", "passenger_id", "last_name"))


@check(
    "users",
    "SELECT user_id, first_name, last_name, email, phone, date_of_birth, address, role, status, created_at, updated_at FROM users",
)
def users_public(users):
    return listings.users_public(users)


@check(
    "passengers",
    f"""SELECT p.user_id, {PERSON}, p.first_name, p.last_name, p.is_saved, p.created_at
FROM passengers p WHERE is_saved = 1""",
)
def saved_passengers(passengers):
    return listings.saved_passengers(passengers)


@check("aircraft", "SELECT * REPLACE (CAST(capacity AS INTEGER) AS capacity) FROM aircraft")
def aircraft_list(aircraft):
    return listings.aircraft_list(aircraft)


@check(
    "bookings users",
    "SELECT booking_id, user_id FROM bookings WHERE user_id IN (SELECT user_id FROM users WHERE status = 'active')",
)
def active_users(bookings, users):
    return listings.active_users(bookings.select("booking_id", "user_id"), users)
