"""Change feeds: the decision on every change, and the table they leave."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from checks import check
from checks.requests import coded, name_rules
from fixtures import AS_OF
from tarmac.operators import booking_changes as bookings_feed
from tarmac.operators import table_changes as feeds
from tarmac.sources.work import stored

# Bookings: the changes of a booking one after the other
STATIC = """CASE WHEN c.op = 'user_status' AND (c.status IS NULL OR c.status NOT IN ('completed', 'missed', 'cancelled')) THEN 'invalid_status'
WHEN c.op = 'admin_status' AND (c.status IS NULL OR c.status NOT IN ('pending', 'confirmed', 'cancelled', 'completed')) THEN 'invalid_status'
WHEN c.op <> 'admin_status' AND c.requester_id <> b.user_id THEN 'booking_not_found' ELSE '' END"""


def step(before: str) -> str:
    """One change ``q`` on the state ``before``: reason, status and payment afterwards."""
    cancel = f"q.op = 'cancel' AND q.static = ''"
    reason = f"""CASE WHEN q.static <> '' THEN q.static WHEN {cancel} AND {before}.status = 'cancelled' THEN 'already_cancelled'
WHEN {cancel} AND {before}.status = 'completed' THEN 'already_completed' ELSE '' END"""
    return f"""{reason} AS reasons, CASE WHEN {reason} <> '' THEN {before}.status WHEN q.op = 'cancel' THEN 'cancelled' ELSE q.new_status END AS status,
CASE WHEN {reason} <> '' THEN {before}.payment_status WHEN q.op = 'cancel' THEN 'refunded'
WHEN q.op = 'admin_status' AND q.new_payment IS NOT NULL THEN q.new_payment ELSE {before}.payment_status END AS payment_status,
CASE WHEN {reason} <> '' THEN {before}.updated_at ELSE q.change_ts END AS updated_at"""


WALK = f"""q AS (SELECT c.change_id, c.change_ts, c.booking_id, c.op, c.status AS new_status, c.payment_status AS new_payment, {STATIC} AS static,
row_number() OVER (PARTITION BY c.booking_id ORDER BY c.change_ts, c.change_id) AS place
FROM booking_changes c JOIN bookings b ON b.booking_id = c.booking_id),
base AS (SELECT booking_id, status, payment_status, updated_at FROM bookings),
walk AS (SELECT q.change_id, q.booking_id, q.place, {step('base')} FROM q JOIN base ON base.booking_id = q.booking_id WHERE q.place = 1
UNION ALL SELECT q.change_id, q.booking_id, q.place, {step('walk')} FROM walk JOIN q ON q.booking_id = walk.booking_id AND q.place = walk.place + 1)"""


@check("booking_changes bookings", f"WITH RECURSIVE {WALK} SELECT change_id, reasons FROM walk")
def booking_changes(changes, bookings):
    return bookings_feed.decide_changes(bookings, changes).summary.select("change_id", "reasons")


@check(
    "booking_changes bookings",
    f"""WITH RECURSIVE {WALK}, last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY booking_id ORDER BY place DESC) = 1)
SELECT b.booking_id, CASE WHEN l.booking_id IS NULL THEN b.status ELSE l.status END AS status,
CASE WHEN l.booking_id IS NULL THEN b.payment_status ELSE l.payment_status END AS payment_status, coalesce(l.updated_at, b.updated_at) AS updated_at
FROM bookings b LEFT JOIN last l ON l.booking_id = b.booking_id""",
)
def booking_changes_applied(changes, bookings):
    outcome = bookings_feed.decide_changes(bookings, changes).stored("booking-changes")
    new = bookings_feed.apply_changes(bookings, outcome.accepted)
    return new.select("booking_id", "status", "payment_status", "updated_at")


# User status
USER_STATUS = """d AS (SELECT c.*, CASE WHEN c.status NOT IN ('active', 'inactive', 'suspended') THEN 'status_unknown'
WHEN c.user_id = c.admin_id AND c.status <> 'active' THEN 'own_status' WHEN u.user_id IS NULL THEN 'user_not_found'
WHEN u.role = 'admin' AND c.status <> 'active' THEN 'admin_status' ELSE '' END AS reasons
FROM user_status_requests c LEFT JOIN users u ON u.user_id = c.user_id)"""


@check("user_status_requests users", f"WITH {USER_STATUS} SELECT change_id, reasons FROM d")
def user_status_changes(changes, users):
    return feeds.user_status_changes(users, changes).summary.select("change_id", "reasons")


@check(
    "user_status_requests users",
    f"""WITH {USER_STATUS}, last AS (SELECT * FROM d WHERE reasons = ''
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY change_ts DESC, change_id DESC) = 1)
SELECT u.user_id, coalesce(l.status, u.status) AS status, coalesce(l.change_ts, u.updated_at) AS updated_at FROM users u LEFT JOIN last l ON l.user_id = u.user_id""",
)
def user_status_applied(changes, users):
    accepted = feeds.user_status_changes(users, changes).stored("user-status").accepted
    return feeds.apply_user_status(users, accepted).select("user_id", "status", "updated_at")


# Partial updates. The feeds are stored first: a map that arrives in a table is read, not built anew for every use.
def as_map(*fields: tuple[str, str, str]) -> Column:
    """(key, flag, value) columns as a map without the keys whose flag is 0."""
    entries = [
        F.when(F.col(flag) == 1, F.struct(F.lit(key).alias("key"), F.col(value).alias("value"))) for key, flag, value in fields
    ]
    return F.map_from_entries(F.array_compact(F.array(*entries))).alias("changes")


def claims(feed: str, entity: str, base: str, value: str, column: str, code: str) -> str:
    """Decisions ``d`` on the rows ``t`` (with early and late reasons): who gets the unique ``value``."""
    return f"""first AS (SELECT {value} AS v, arg_min({entity}, (change_ts, change_id)) AS holder, min((change_ts, change_id)) AS k
FROM t WHERE early = '' AND late = '' AND {value} IS NOT NULL GROUP BY {value}),
held AS (SELECT {column} AS v, {entity} AS holder FROM {base}),
d AS (SELECT t.*, CASE WHEN early <> '' THEN early WHEN held.v IS NOT NULL AND held.holder <> t.{entity} THEN '{code}'
WHEN held.v IS NULL AND first.v IS NOT NULL AND first.holder <> t.{entity} AND first.k < (t.change_ts, t.change_id) THEN '{code}'
ELSE late END AS reasons FROM t LEFT JOIN first ON first.v = t.{value} LEFT JOIN held ON held.v = t.{value})"""


def last_value(entity: str, base: str, flag: str, value: str) -> str:
    """The last accepted value per field, as a scalar expression over row ``b`` of the base."""
    return f"""CASE WHEN (SELECT count(*) FROM d WHERE reasons = '' AND {flag} = 1 AND d.{entity} = b.{entity}) = 0 THEN {base}
ELSE (SELECT arg_max(struct_pack(x := {value}), (change_ts, change_id)) FROM d WHERE reasons = '' AND {flag} = 1 AND d.{entity} = b.{entity}).x END"""


def updated(entity: str) -> str:
    return f"coalesce((SELECT max(change_ts) FROM d WHERE reasons = '' AND d.{entity} = b.{entity}), b.updated_at) AS updated_at"


EMAIL = "^[a-z0-9!#$%&''*+/=?^_`{|}~.-]+@([a-z0-9-]+\\.)+[a-z]{2,}$"
PROFILES = f"""t AS (SELECT f.change_id, f.change_ts, f.user_id, has_first_name, f.first_name,
CASE WHEN has_email = 1 THEN lower(trim(f.email)) END AS email, has_email, has_address, nullif(f.address, '') AS address,
CASE WHEN u.user_id IS NULL THEN 'user_not_found' ELSE {coded(
    *[(f"has_first_name = 1 AND {cond}", code) for cond, code in name_rules('first_name', 'f.first_name')],
    (f"has_email = 1 AND NOT regexp_matches(lower(trim(f.email)), '{EMAIL}')", 'email_format'))} END AS early,
CASE WHEN has_first_name + has_email + has_address = 0 THEN 'no_fields' ELSE '' END AS late
FROM profile_feed f LEFT JOIN users u ON u.user_id = f.user_id),
{claims('profile_feed', 'user_id', 'users', 'email', 'email', 'email_taken')}"""


def _profile_changes(feed):
    changes = as_map(
        ("firstName", "has_first_name", "first_name"),
        ("email", "has_email", "email"),
        ("address", "has_address", "address"),
    )
    return stored(feed.select("change_id", "change_ts", "user_id", changes), "profile-feed")


@check("profile_feed users", f"WITH {PROFILES} SELECT change_id, reasons FROM d")
def profile_updates(feed, users):
    return feeds.profile_updates(users, _profile_changes(feed), AS_OF).summary.select("change_id", "reasons")


@check(
    "profile_feed users",
    f"""WITH {PROFILES} SELECT b.user_id, {last_value('user_id', 'b.first_name', 'has_first_name', 'first_name')} AS first_name,
{last_value('user_id', 'b.email', 'has_email', 'email')} AS email,
{last_value('user_id', 'b.address', 'has_address', 'address')} AS address, {updated('user_id')} FROM users b""",
)
def profiles_applied(feed, users):
    accepted = feeds.profile_updates(users, _profile_changes(feed), AS_OF).stored("profiles").accepted
    return feeds.apply_profiles(users, accepted).select("user_id", "first_name", "email", "address", "updated_at")


AIRCRAFT = f"""t AS (SELECT f.change_id, f.change_ts, f.aircraft_id, has_model, f.model, has_registration,
CASE WHEN has_registration = 1 THEN f.registration END AS registration, has_capacity, CAST(f.capacity AS INTEGER) AS capacity,
CASE WHEN {coded(("has_model = 1 AND f.model = ''", 'x'), ("has_registration = 1 AND f.registration = 'bad reg'", 'x'),
    ("has_capacity = 1 AND f.capacity = '1001'", 'x'))} <> '' THEN {coded(("has_model = 1 AND f.model = ''", 'model_required'),
    ("has_registration = 1 AND f.registration = 'bad reg'", 'registration_characters'),
    ("has_capacity = 1 AND f.capacity = '1001'", 'capacity_range'))} WHEN u.aircraft_id IS NULL THEN 'aircraft_not_found' ELSE '' END AS early,
CASE WHEN has_model + has_registration + has_capacity = 0 THEN 'no_fields' ELSE '' END AS late
FROM aircraft_feed f LEFT JOIN fleet u ON u.aircraft_id = f.aircraft_id),
{claims('aircraft_feed', 'aircraft_id', 'fleet', 'registration', 'registration', 'registration_taken')}"""


def _aircraft_changes(feed):
    changes = as_map(
        ("model", "has_model", "model"),
        ("registration", "has_registration", "registration"),
        ("capacity", "has_capacity", "capacity"),
    )
    return stored(feed.select("change_id", "change_ts", "aircraft_id", changes), "aircraft-feed")


@check("aircraft_feed fleet", f"WITH {AIRCRAFT} SELECT change_id, reasons FROM d")
def aircraft_updates(feed, fleet):
    return feeds.aircraft_updates(fleet, _aircraft_changes(feed)).summary.select("change_id", "reasons")


@check(
    "aircraft_feed fleet",
    f"""WITH {AIRCRAFT} SELECT b.aircraft_id, {last_value('aircraft_id', 'b.model', 'has_model', 'model')} AS model,
{last_value('aircraft_id', 'b.registration', 'has_registration', 'registration')} AS registration,
CAST({last_value('aircraft_id', 'b.capacity', 'has_capacity', 'capacity')} AS INTEGER) AS capacity, b.status FROM fleet b""",
)
def aircraft_applied(feed, fleet):
    accepted = feeds.aircraft_updates(fleet, _aircraft_changes(feed)).stored("aircraft").accepted
    new = feeds.apply_aircraft(fleet.withColumn("capacity", F.col("capacity").cast("int")), accepted)
    return new.select("aircraft_id", "model", "registration", "capacity", "status")


FLIGHTS = f"""t AS (SELECT f.change_id, f.change_ts, f.flight_id, CASE WHEN has_flight_number = 1 AND f.flight_number <> '' THEN 1 ELSE 0 END AS has_flight_number,
CASE WHEN has_flight_number = 1 AND f.flight_number <> '' THEN f.flight_number END AS flight_number, has_times,
CAST(f.departure_datetime AS TIMESTAMP) AS departure_datetime, CAST(f.arrival_datetime AS TIMESTAMP) AS arrival_datetime, has_base_price,
CAST(f.base_price AS DECIMAL(10,2)) AS base_price, CASE WHEN u.flight_id IS NULL THEN 'flight_not_found' ELSE '' END AS early,
CASE WHEN (has_flight_number = 0 OR f.flight_number = '') AND has_times + has_base_price = 0 THEN 'no_fields'
WHEN has_times = 1 AND f.arrival_datetime = f.departure_datetime THEN 'arrival_not_after_departure' ELSE '' END AS late
FROM flight_feed f LEFT JOIN flights u ON u.flight_id = f.flight_id),
{claims('flight_feed', 'flight_id', 'flights', 'flight_number', 'flight_number', 'flight_number_taken')}"""


def _flight_changes(feed):
    changes = as_map(
        ("flight_number", "has_flight_number", "flight_number"),
        ("departure_datetime", "has_times", "departure_datetime"),
        ("arrival_datetime", "has_times", "arrival_datetime"),
        ("base_price", "has_base_price", "base_price"),
    )
    return stored(feed.select("change_id", "change_ts", "flight_id", changes), "flight-feed")


@check("flight_feed flights", f"WITH {FLIGHTS} SELECT change_id, reasons FROM d")
def flight_updates(feed, flights):
    return feeds.flight_updates(flights, _flight_changes(feed)).summary.select("change_id", "reasons")


@check(
    "flight_feed flights",
    f"""WITH {FLIGHTS} SELECT b.flight_id, {last_value('flight_id', 'b.flight_number', 'has_flight_number', 'flight_number')} AS flight_number,
{last_value('flight_id', 'b.departure_datetime', 'has_times', 'departure_datetime')} AS departure_datetime,
{last_value('flight_id', 'b.arrival_datetime', 'has_times', 'arrival_datetime')} AS arrival_datetime,
{last_value('flight_id', 'b.base_price', 'has_base_price', 'base_price')} AS base_price, {updated('flight_id')} FROM flights b""",
)
def flights_applied(feed, flights):
    accepted = feeds.flight_updates(flights, _flight_changes(feed)).stored("flights").accepted
    new = feeds.apply_flights(flights, accepted)
    return new.select(
        "flight_id", "flight_number", "departure_datetime", "arrival_datetime", "base_price", "updated_at"
    )


# Deletes
def deletes(feed: str, base: str, entity: str, uses: str, missing: str, blocked: str) -> str:
    return f"""d AS (SELECT r.request_id, r.{entity}, CASE WHEN b.{entity} IS NULL THEN '{missing}' WHEN u.n > 0 THEN '{blocked}'
WHEN row_number() OVER (PARTITION BY r.{entity} ORDER BY r.request_id) > 1 THEN '{missing}' ELSE '' END AS reasons, u.n
FROM {feed} r LEFT JOIN {base} b ON b.{entity} = r.{entity} LEFT JOIN ({uses}) u ON u.{entity} = r.{entity})"""


DECIDED = "SELECT request_id, reasons, CASE WHEN reasons = '{blocked}' THEN n ELSE 0 END AS uses FROM d"
FLIGHT_DELETES = deletes(
    "flight_deletes",
    "flights",
    "flight_id",
    "SELECT flight_id, count(*) AS n FROM bookings WHERE status NOT IN ('cancelled', 'completed') GROUP BY flight_id",
    "flight_not_found",
    "active_bookings",
)
AIRCRAFT_DELETES = deletes(
    "aircraft_deletes",
    "aircraft",
    "aircraft_id",
    "SELECT aircraft_id, count(*) AS n FROM flights GROUP BY aircraft_id",
    "aircraft_not_found",
    "used_by_flights",
)


def _reasons(outcome):
    return outcome.decided.select("request_id", F.array_join("reasons", "; ").alias("reasons"), "uses")


@check("flight_deletes flights bookings", f"WITH {FLIGHT_DELETES} {DECIDED.format(blocked='active_bookings')}")
def delete_flights(requests, flights, bookings):
    return _reasons(feeds.delete_flights(requests, flights, bookings))


@check(
    "flight_deletes flights bookings",
    f"WITH {FLIGHT_DELETES} SELECT flight_id, flight_number FROM flights WHERE flight_id NOT IN (SELECT flight_id FROM d WHERE reasons = '')",
)
def flights_left(requests, flights, bookings):
    accepted = feeds.delete_flights(requests, flights, bookings).stored("deletes").accepted
    return feeds.without(flights, accepted, "flight_id").select("flight_id", "flight_number")


@check("aircraft_deletes aircraft flights", f"WITH {AIRCRAFT_DELETES} {DECIDED.format(blocked='used_by_flights')}")
def delete_aircraft(requests, aircraft, flights):
    return _reasons(feeds.delete_aircraft(requests, aircraft, flights))


@check(
    "aircraft_deletes aircraft flights",
    f"""WITH {AIRCRAFT_DELETES} SELECT aircraft_id, registration FROM aircraft
WHERE aircraft_id NOT IN (SELECT aircraft_id FROM d WHERE reasons = '')""",
)
def aircraft_left(requests, aircraft, flights):
    accepted = feeds.delete_aircraft(requests, aircraft, flights).stored("deletes").accepted
    return feeds.without(aircraft, accepted, "aircraft_id").select("aircraft_id", "registration")
