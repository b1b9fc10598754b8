"""Partial updates as JSON bodies, with absent, null and empty fields told apart and types kept."""

from pyspark.sql import functions as F

from checks import check
from checks.changes import EMAIL, claims, last_value, updated
from checks.requests import YEAR, coded, name_rules
from fixtures import AS_OF
from tarmac.operators import table_changes as feeds
from tarmac.sources.work import stored


def _bodies(feed, entity):
    bodies = feed.select("change_id", "change_ts", entity, F.try_parse_json("body").alias("changes"))
    return stored(bodies, "bodies")


def opened(feed: str, entity: str, keys: dict[str, str]) -> str:
    """``o``: the bodies with has_, kind_ and raw_ of every field, and why a body cannot be read."""
    parts = []
    for field, key in keys.items():
        path = f"'$.{key}'"
        parts += [f"j ->> {path} AS raw_{field}", f"json_type(j, {path}) AS kind_{field}"]
    kinds = ", ".join(f"kind_{f}" for f in keys)
    given = ", ".join(f"CASE WHEN kind_{f} IS NULL THEN 0 ELSE 1 END AS has_{f}" for f in keys)
    zero = ", ".join(
        f"coalesce(raw_{f} = '' OR (kind_{f} <> 'VARCHAR' AND (raw_{f} = 'false' OR TRY_CAST(raw_{f} AS DOUBLE) = 0)), FALSE) AS no_{f}"
        for f in keys
    )
    return f"""j AS (SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM {feed}),
k AS (SELECT change_id, change_ts, {entity}, json_type(j) AS kind, {', '.join(parts)} FROM j),
o AS (SELECT *, {given}, {zero}, CASE WHEN coalesce(kind, '') <> 'OBJECT' THEN 'invalid_body'
WHEN list_has_any([{kinds}], ['OBJECT', 'ARRAY']) THEN 'nested_value' ELSE '' END AS broken FROM k)"""


def trimmed(field: str) -> str:
    return f"trim(coalesce(raw_{field}, ''))"


def when(field: str, *rules: tuple[str, str]) -> list[tuple[str, str]]:
    return [(f"has_{field} = 1 AND {cond}", code) for cond, code in rules]


PROFILE = dict(first_name="firstName", last_name="lastName", email="email", phone="phone", date_of_birth="dateOfBirth", address="address")
BORN = "CASE WHEN regexp_matches(raw_date_of_birth, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(raw_date_of_birth AS DATE) END"
PROFILES = f"""{opened('profile_bodies', 'user_id', PROFILE)},
v AS (SELECT o.*, u.user_id AS known, {trimmed('first_name')} AS first_name, {trimmed('last_name')} AS last_name, CASE WHEN has_email = 1 THEN lower({trimmed('email')}) END AS email,
nullif({trimmed('phone')}, '') AS phone, {BORN} AS date_of_birth, nullif({trimmed('address')}, '') AS address FROM o LEFT JOIN users u ON u.user_id = o.user_id),
t AS (SELECT v.*, CASE WHEN broken <> '' THEN broken WHEN known IS NULL THEN 'user_not_found' ELSE {coded(
    *when('first_name', *name_rules('first_name', 'first_name')), *when('last_name', *name_rules('last_name', 'last_name')),
    *when('email', (f"NOT regexp_matches(email, '{EMAIL}')", 'email_format')),
    *when('phone', (r"NOT regexp_matches(coalesce(phone, ''), '^[\d\s\-+()]+$')", 'phone_format')),
    *when('date_of_birth', ("date_of_birth IS NULL", 'date_of_birth_format'), (f"{YEAR} - year(date_of_birth) NOT BETWEEN 0 AND 120", 'date_of_birth_range')))} END AS early,
CASE WHEN {' + '.join(f'has_{f}' for f in PROFILE)} = 0 THEN 'no_fields' ELSE '' END AS late FROM v),
{claims('profile_bodies', 'user_id', 'users', 'email', 'email', 'email_taken')}"""
AIRCRAFT = {f: f for f in feeds.AIRCRAFT_FIELDS}
FLEET = f"""{opened('aircraft_bodies', 'aircraft_id', AIRCRAFT)},
v AS (SELECT o.*, u.aircraft_id AS known, {trimmed('model')} AS model, CASE WHEN has_registration = 1 THEN upper({trimmed('registration')}) END AS registration,
CASE WHEN regexp_matches(raw_capacity, '^[-+]?[0-9]+$') THEN TRY_CAST(raw_capacity AS INTEGER) END AS capacity, raw_status AS status
FROM o LEFT JOIN fleet u ON u.aircraft_id = o.aircraft_id),
w AS (SELECT v.*, {coded(*when('model', ("model = ''", 'model_required')),
    *when('registration', ("registration = ''", 'registration_required'), (f"NOT regexp_matches({trimmed('registration')}, '^[A-Z0-9-]+$')", 'registration_characters')),
    *when('capacity', ("coalesce(capacity, 0) NOT BETWEEN 1 AND 1000", 'capacity_range')),
    *when('status', ("coalesce(status, '') NOT IN ('active', 'maintenance', 'retired')", 'status_unknown')))} AS invalid FROM v),
t AS (SELECT w.*, CASE WHEN broken <> '' THEN broken WHEN invalid <> '' THEN invalid WHEN known IS NULL THEN 'aircraft_not_found' ELSE '' END AS early,
CASE WHEN {' + '.join(f'has_{f}' for f in AIRCRAFT)} = 0 THEN 'no_fields' ELSE '' END AS late FROM w),
{claims('aircraft_bodies', 'aircraft_id', 'fleet', 'registration', 'registration', 'registration_taken')}"""
FLIGHT = {f: f for f in feeds.FLIGHT_FIELDS}
CASTS = {
    "aircraft_id": "TRY_CAST(nullif(regexp_extract({}, '^\\s*([+-]?\\d+)', 1), '') AS BIGINT)",
    **{f: "TRY_CAST({} AS TIMESTAMP)" for f in ("departure_datetime", "arrival_datetime")},
    **{f: "TRY_CAST({} AS DECIMAL(10,2))" for f in feeds.PRICE_FIELDS},
}


def flight_value(field: str) -> str:
    text = f"raw_{field}" if field in feeds.PRICE_FIELDS else f"CASE WHEN NOT no_{field} THEN raw_{field} END"
    return f"({text}) AS text_{field}, {CASTS.get(field, '{}').format(f'({text})')} AS {field}"


FLIGHTS = f"""{opened('flight_bodies', 'flight_id', FLIGHT)},
x AS (SELECT o.change_id, o.change_ts, o.flight_id, broken, u.flight_id AS known, {', '.join(flight_value(f) for f in FLIGHT)}
FROM o LEFT JOIN (SELECT flight_id FROM flights) u ON u.flight_id = o.flight_id),
v AS (SELECT x.*, {', '.join(f'CASE WHEN text_{f} IS NULL THEN 0 ELSE 1 END AS has_{f}' for f in FLIGHT)} FROM x),
t AS (SELECT v.*, CASE WHEN broken <> '' THEN broken WHEN known IS NULL THEN 'flight_not_found' ELSE '' END AS early,
CASE WHEN {' + '.join(f'has_{f}' for f in FLIGHT)} = 0 THEN 'no_fields' WHEN arrival_datetime <= departure_datetime THEN 'arrival_not_after_departure'
WHEN {' OR '.join(f'has_{f} = 1 AND {f} IS NULL' for f in FLIGHT)} THEN 'invalid_value' ELSE '' END AS late FROM v),
{claims('flight_bodies', 'flight_id', 'flights', 'flight_number', 'flight_number', 'flight_number_taken')}"""


def applied(entity: str, base: str, fields: dict[str, str]) -> str:
    return ", ".join(f"{last_value(entity, f'b.{f}', f'has_{f}', f)} AS {f}" for f in fields)


@check("profile_bodies users", f"WITH {PROFILES} SELECT change_id, reasons FROM d")
def profile_body_updates(feed, users):
    return feeds.profile_updates(users, _bodies(feed, "user_id"), AS_OF).summary.select("change_id", "reasons")


@check(
    "profile_bodies users",
    f"WITH {PROFILES} SELECT b.user_id, {applied('user_id', 'users', PROFILE)}, {updated('user_id')} FROM users b",
)
def profile_bodies_applied(feed, users):
    accepted = feeds.profile_updates(users, _bodies(feed, "user_id"), AS_OF).stored("profiles").accepted
    return feeds.apply_profiles(users, accepted).select("user_id", *PROFILE, "updated_at")


@check("aircraft_bodies fleet", f"WITH {FLEET} SELECT change_id, reasons FROM d")
def aircraft_body_updates(feed, fleet):
    return feeds.aircraft_updates(fleet, _bodies(feed, "aircraft_id")).summary.select("change_id", "reasons")


@check(
    "aircraft_bodies fleet",
    f"""WITH {FLEET} SELECT aircraft_id, model, registration, CAST(capacity AS INTEGER) AS capacity, status
FROM (SELECT b.aircraft_id, {applied('aircraft_id', 'fleet', AIRCRAFT)} FROM fleet b) z""",
)
def aircraft_bodies_applied(feed, fleet):
    accepted = feeds.aircraft_updates(fleet, _bodies(feed, "aircraft_id")).stored("aircraft").accepted
    new = feeds.apply_aircraft(fleet.withColumn("capacity", F.col("capacity").cast("int")), accepted)
    return new.select("aircraft_id", *AIRCRAFT)


@check("flight_bodies flights", f"WITH {FLIGHTS} SELECT change_id, reasons FROM d")
def flight_body_updates(feed, flights):
    return feeds.flight_updates(flights, _bodies(feed, "flight_id")).summary.select("change_id", "reasons")


@check(
    "flight_bodies flights",
    f"WITH {FLIGHTS} SELECT b.flight_id, {applied('flight_id', 'flights', FLIGHT)}, {updated('flight_id')} FROM flights b",
)
def flight_bodies_applied(feed, flights):
    accepted = feeds.flight_updates(flights, _bodies(feed, "flight_id")).stored("flights").accepted
    return feeds.apply_flights(flights, accepted).select("flight_id", *FLIGHT, "updated_at")
