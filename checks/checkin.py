"""Check-in."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from checks import check
from checks.listings import ROUTED
from fixtures import NOW
from tarmac.operators import checkin

BAD_NAME = "length(t.name) NOT BETWEEN 2 AND 100 OR NOT regexp_matches(t.name, '^[a-zA-Z\\s''-]+$')"
BAD_REFERENCE = "length(t.ref) NOT BETWEEN 5 AND 20 OR NOT regexp_matches(t.ref, '^[A-Z0-9]+$')"
GAP = f"epoch_ms(f.departure_datetime) - epoch_ms(TIMESTAMP '{NOW}')"

DECISIONS = f"""t AS (SELECT request_id, user_id, trim(booking_reference) AS ref, trim(last_name) AS name FROM checkin_requests),
b AS (SELECT b.*, f.flight_number, f.departure_datetime, dep.city AS from_city, arr.city AS to_city FROM bookings b {ROUTED}),
names AS (SELECT DISTINCT bp.booking_id, lower(p.last_name) AS name FROM booking_passengers bp JOIN passengers p ON p.passenger_id = bp.passenger_id),
d AS (SELECT t.request_id, f.booking_id, f.flight_number, f.departure_datetime, f.from_city, f.to_city,
CASE WHEN {BAD_REFERENCE} OR {BAD_NAME} THEN 'invalid_request' WHEN f.booking_id IS NULL THEN 'booking_not_found'
WHEN f.user_id <> t.user_id THEN 'access_denied' WHEN f.status <> 'confirmed' THEN 'not_confirmed'
WHEN n.name IS NULL THEN 'last_name_mismatch' WHEN c.status = 'completed' THEN 'already_checked_in'
WHEN f.departure_datetime < TIMESTAMP '{NOW}' THEN 'departed'
WHEN f.departure_datetime > TIMESTAMP '{NOW}' + INTERVAL '24' HOUR THEN 'window_not_open' ELSE '' END AS reasons,
CAST(ceil(({GAP}) / 3600000 - 24) AS BIGINT) AS hours FROM t LEFT JOIN b f ON f.booking_reference = t.ref
LEFT JOIN names n ON n.booking_id = f.booking_id AND n.name = lower(t.name) LEFT JOIN check_ins c ON c.booking_id = f.booking_id)"""


@check(
    "checkin_requests bookings flights airports booking_passengers passengers check_ins",
    f"""WITH {DECISIONS} SELECT request_id, reasons, CASE WHEN reasons = 'window_not_open' THEN hours END AS opens_in_hours,
CASE WHEN reasons = '' THEN booking_id END AS booking_id, CASE WHEN reasons = '' THEN flight_number END AS flight_number,
CASE WHEN reasons = '' THEN from_city END AS from_city, CASE WHEN reasons = '' THEN to_city END AS to_city FROM d""",
)
def checkin_eligibility(requests, bookings, flights, airports, booking_passengers, passengers, check_ins):
    outcome = checkin.checkin_eligibility(
        requests, bookings, flights, airports, booking_passengers, passengers, check_ins, NOW
    )
    kept: list[Column] = [
        F.when(F.size("reasons") == 0, F.col(c)).alias(c)
        for c in ("booking_id", "flight_number", "from_city", "to_city")
    ]
    return outcome.decided.select(
        "request_id", F.array_join("reasons", "; ").alias("reasons"), "opens_in_hours", *kept
    )


@check(
    "checkin_requests bookings flights airports booking_passengers passengers check_ins",
    f"""WITH {DECISIONS} SELECT d.request_id, d.booking_id, string_agg(p.last_name || '=' || p.first_name || '=' ||
CAST(bp.booking_passenger_id AS VARCHAR), '; ' ORDER BY p.last_name, p.first_name, bp.booking_passenger_id) AS passengers
FROM d JOIN booking_passengers bp ON bp.booking_id = d.booking_id JOIN passengers p ON p.passenger_id = bp.passenger_id
WHERE d.reasons = '' GROUP BY d.request_id, d.booking_id""",
)
def checkin_passengers(requests, bookings, flights, airports, booking_passengers, passengers, check_ins):
    from checks import text

    outcome = checkin.checkin_eligibility(
        requests, bookings, flights, airports, booking_passengers, passengers, check_ins, NOW
    ).stored("eligible")
    nested = checkin.eligible_with_passengers(outcome.accepted, booking_passengers, passengers)
    return nested.select("request_id", "booking_id", text("passengers", "last_name", "first_name", "booking_passenger_id"))


CONFIRMATIONS = f"""t AS (SELECT r.*, b.user_id AS owner_id, b.status, f.departure_datetime, c.booking_id AS checked_in, m.n AS passenger_count,
concat_ws('; ', CASE WHEN r.booking_id < 1 THEN 'booking_id_invalid' END, CASE WHEN trim(seat_suffix) = '' THEN 'seat_number_blank' END,
CASE WHEN length(gate_number) > 10 THEN 'gate_number_length' END) AS early
FROM confirm_feed r LEFT JOIN bookings b ON b.booking_id = r.booking_id LEFT JOIN flights f ON f.flight_id = b.flight_id
LEFT JOIN (SELECT DISTINCT booking_id FROM check_ins) c ON c.booking_id = r.booking_id
LEFT JOIN (SELECT booking_id, count(*) AS n FROM booking_passengers GROUP BY booking_id) m ON m.booking_id = r.booking_id),
u AS (SELECT t.*, CASE WHEN early <> '' THEN early WHEN owner_id IS NULL OR owner_id <> user_id OR status <> 'confirmed' THEN 'booking_not_found'
WHEN checked_in IS NOT NULL THEN 'already_checked_in' WHEN departure_datetime < TIMESTAMP '{NOW}' THEN 'departed'
WHEN departure_datetime > TIMESTAMP '{NOW}' + INTERVAL '24' HOUR THEN 'window_not_open'
WHEN n_seats <> passenger_count THEN 'seat_count_mismatch' ELSE '' END AS alone FROM t),
w AS (SELECT booking_id, min(request_id) AS first_id FROM u WHERE alone = '' GROUP BY booking_id),
d AS (SELECT u.*, CASE WHEN w.first_id < u.request_id AND early = '' AND alone <> 'booking_not_found' THEN 'already_checked_in' ELSE alone END AS reasons
FROM u LEFT JOIN w ON w.booking_id = u.booking_id)"""


def _requests(feed):
    """The feed with its seats as an array: '1 a', '2 a', ... or blanks."""
    seat = F.when(F.trim("seat_suffix") == "", F.lit("  "))
    seats = F.transform(
        F.sequence(F.lit(1), F.col("n_seats").cast("int")),
        lambda i: F.coalesce(seat, F.concat(i.cast("string"), F.col("seat_suffix"))),
    )
    return feed.select("request_id", "user_id", "booking_id", seats.alias("seat_numbers"), "gate_number")


@check(
    "confirm_feed bookings flights booking_passengers check_ins",
    f"""WITH {CONFIRMATIONS} SELECT request_id, reasons, CASE WHEN reasons = '' THEN booking_id END AS booking_id,
CASE WHEN reasons = '' THEN TIMESTAMP '{NOW}' END AS check_in_datetime, CASE WHEN reasons = '' THEN coalesce(gate_number, 'TBA') END AS gate_number,
CASE WHEN reasons = '' THEN departure_datetime - INTERVAL '30' MINUTE END AS boarding_time FROM d""",
)
def confirm_checkins(feed, bookings, flights, booking_passengers, check_ins):
    outcome = checkin.confirm_checkins(_requests(feed), bookings, flights, booking_passengers, check_ins, NOW)
    return outcome.summary.drop("seat_numbers")


@check(
    "confirm_feed bookings flights booking_passengers check_ins",
    f"""WITH {CONFIRMATIONS} SELECT s.booking_passenger_id, s.booking_id, s.passenger_id,
CASE WHEN d.request_id IS NOT NULL THEN CAST(s.place AS VARCHAR) || ' A' ELSE s.seat_number END AS seat_number
FROM (SELECT bp.*, row_number() OVER (PARTITION BY booking_id ORDER BY booking_passenger_id) AS place FROM booking_passengers bp) s
LEFT JOIN d ON d.booking_id = s.booking_id AND d.reasons = ''""",
)
def confirmed_seats(feed, bookings, flights, booking_passengers, check_ins):
    outcome = checkin.confirm_checkins(_requests(feed), bookings, flights, booking_passengers, check_ins, NOW)
    outcome = outcome.stored("confirmed")
    return checkin.with_seats(booking_passengers, checkin.seat_updates(outcome.accepted, booking_passengers))


@check(
    "confirm_feed bookings flights booking_passengers check_ins",
    f"""WITH {CONFIRMATIONS} SELECT 5000000 + request_id AS check_in_id, booking_id, TIMESTAMP '{NOW}' AS check_in_datetime,
coalesce(gate_number, 'TBA') AS gate_number, departure_datetime - INTERVAL '30' MINUTE AS boarding_time, 'completed' AS status
FROM d WHERE reasons = ''""",
)
def check_in_rows(feed, bookings, flights, booking_passengers, check_ins):
    outcome = checkin.confirm_checkins(_requests(feed), bookings, flights, booking_passengers, check_ins, NOW)
    return checkin.check_in_rows(outcome.accepted, 5_000_000)
