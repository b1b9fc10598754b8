"""Comparison that ignores case and accents, against the oracle's own folding of texts."""

from pyspark.sql import functions as F

from checks import WRITTEN, check
from checks.changes import _profile_changes
from checks.kept_reports import renamed
from fixtures import AS_OF, NOW
from tarmac.functions.collation import IGNORE_CASE_AND_ACCENTS as ANY, one_spelling
from tarmac.operators import checkin, listings, reports, requests, table_changes

SPELLED = "spelled AS (SELECT airport_code, min(city) OVER (PARTITION BY strip_accents(lower(city))) AS city FROM accented_airports)"


def replaced(sql: str, *changes: tuple[str, str]) -> str:
    for old, new in changes:
        assert old in sql, old
        sql = sql.replace(old, new)
    return sql


@check("bookings flights accented_airports", f"WITH {SPELLED} {renamed(WRITTEN['popular_routes_city'], airports='spelled')}")
def popular_routes_any_spelling(bookings, flights, airports):
    return reports.popular_routes_city(bookings, flights, one_spelling(airports, "city", ANY))


@check(
    "registrations accented_users",
    replaced(
        WRITTEN["register_users"], ("SELECT email FROM users", "SELECT strip_accents(lower(email)) FROM accented_users")
    ),
)
def register_users_any_spelling(registrations, users):
    feed = registrations.withColumn("address", F.lit(None).cast("string"))
    return requests.register_users(feed, users, AS_OF, ANY).summary


@check(
    "profile_feed accented_users",
    replaced(
        WRITTEN["profile_updates"],
        ("SELECT email AS v, user_id AS holder FROM users", "SELECT strip_accents(lower(email)) AS v, user_id AS holder FROM accented_users"),
    ),
)
def profile_updates_any_spelling(feed, users):
    decided = table_changes.profile_updates(users, _profile_changes(feed), AS_OF, ANY)
    return decided.summary.select("change_id", "reasons")


@check(
    "checkin_requests bookings flights airports booking_passengers accented_passengers check_ins",
    replaced(
        WRITTEN["checkin_eligibility"],
        ("lower(p.last_name)", "strip_accents(lower(p.last_name))"),
        ("JOIN passengers p", "JOIN accented_passengers p"),
    ),
)
def checkin_any_spelling(*given):
    decided = checkin.checkin_eligibility(*given, NOW, ANY).stored("eligible").decided
    kept = [F.when(F.size("reasons") == 0, F.col(c)).alias(c) for c in ("booking_id", "flight_number", "from_city", "to_city")]
    return decided.select("request_id", F.array_join("reasons", "; ").alias("reasons"), "opens_in_hours", *kept)


@check(
    "flights accented_airports aircraft",
    """SELECT f.flight_id, x.city AS from_city, y.city AS to_city FROM flights f JOIN aircraft a ON a.aircraft_id = f.aircraft_id
JOIN accented_airports x ON x.airport_code = f.from_airport_code JOIN accented_airports y ON y.airport_code = f.to_airport_code
WHERE contains(strip_accents(lower(x.city)), 'cordoba 3') OR contains(strip_accents(lower(y.city)), 'cordoba 3')
ORDER BY f.departure_datetime DESC, f.flight_id LIMIT 40 OFFSET 40""",
)
def flights_page_any_spelling(flights, airports, aircraft):
    found = listings.admin_flights_page(flights, airports, aircraft, page=2, limit=40, search=" CÓrdoba 3", collation=ANY)
    return found.select("flight_id", "from_city", "to_city")
