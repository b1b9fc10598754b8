"""Request tables: all requests with their reasons, and the new rows of the accepted ones."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import check
from checks.reports import HELD
from fixtures import AS_OF
from tarmac.functions.expr import HALF_BITS, ROUND_KEYS
from tarmac.operators import admission, requests
from tarmac.operators.admission import admit_bookings as admit
from tarmac.plans.outcome import Outcome

YEAR = AS_OF[:4]


def coded(*rules: tuple[str, str]) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for cond, code in rules) + ")"


def name_rules(field: str, value: str) -> list[tuple[str, str]]:
    return [
        (f"{value} = ''", f"{field}_required"),
        (f"length({value}) NOT BETWEEN 2 AND 100", f"{field}_length"),
        (f"NOT regexp_matches({value}, '^[a-zA-Z\\s''-]+$')", f"{field}_characters"),
    ]


def birth_rules(raw: str, value: str) -> list[tuple[str, str]]:
    return [
        (f"{raw} IS NOT NULL AND {value} IS NULL", "date_of_birth_format"),
        (f"{YEAR} - year({value}) NOT BETWEEN 0 AND 120", "date_of_birth_range"),
    ]


def unique(columns: list[str], value: str, taken: str, code: str) -> str:
    """Of the requests ``c`` (with reasons), the earliest valid one per value is accepted unless it is ``taken``."""
    kept = ", ".join(f"CASE WHEN d.reasons = '' THEN d.{c} END AS {c}" for c in columns)
    return f"""r AS (SELECT c.*, row_number() OVER (PARTITION BY {value}, reasons = '' ORDER BY request_id) AS place FROM c),
d AS (SELECT r.* REPLACE (CASE WHEN reasons <> '' THEN reasons WHEN place > 1 OR {value} IN ({taken}) THEN '{code}' ELSE '' END AS reasons) FROM r)
SELECT request_id, {kept}, reasons FROM d"""


REGISTERED = ["first_name", "last_name", "email", "phone", "date_of_birth", "address", "role", "status"]
EMAIL = "^[a-z0-9!#$%&''*+/=?^_`{|}~.-]+@([a-z0-9-]+\\.)+[a-z]{2,}$"


@check(
    "registrations users",
    f"""WITH t AS (SELECT request_id, trim(first_name) AS first_name, trim(last_name) AS last_name, lower(trim(email)) AS email,
password, confirm_password, trim(phone) AS phone, dob, TRY_CAST(dob AS DATE) AS date_of_birth, CAST(NULL AS VARCHAR) AS address,
'user' AS role, 'active' AS status FROM registrations),
c AS (SELECT t.*, {coded(*name_rules('first_name', 'first_name'), *name_rules('last_name', 'last_name'),
    (f"NOT regexp_matches(email, '{EMAIL}')", 'email_format'), ("length(email) > 255", 'email_length'),
    ("length(password) < 6", 'password_length'),
    ("NOT (regexp_matches(password, '[a-z]') AND regexp_matches(password, '[A-Z]') AND regexp_matches(password, '[0-9]'))", 'password_strength'),
    ("password <> confirm_password", 'password_confirmation'),
    (r"NOT regexp_matches(phone, '^[\d\s\-+()]+$')", 'phone_format'), ("length(phone) > 20", 'phone_length'),
    *birth_rules('dob', 'date_of_birth'))} AS reasons FROM t),
{unique(REGISTERED, 'email', 'SELECT email FROM users', 'email_taken')}""",
)
def register_users(registrations, users):
    from pyspark.sql import functions as F

    feed = registrations.withColumn("address", F.lit(None).cast("string"))
    return requests.register_users(feed, users, AS_OF).summary


ADDED = ["user_id", "first_name", "last_name", "date_of_birth", "passport_number", "nationality", "is_saved"]


@check(
    "passenger_requests",
    f"""WITH t AS (SELECT request_id, user_id, trim(coalesce(first_name, '')) AS first_name, trim(coalesce(last_name, '')) AS last_name,
date_of_birth AS dob, TRY_CAST(date_of_birth AS DATE) AS date_of_birth, passport_number, nationality, 1 AS is_saved FROM passenger_requests),
d AS (SELECT t.*, {coded(*name_rules('first_name', 'first_name'), *name_rules('last_name', 'last_name'), *birth_rules('dob', 'date_of_birth'),
    ("length(passport_number) > 50", 'passport_number_length'), ("length(nationality) > 100", 'nationality_length'))} AS reasons FROM t)
SELECT request_id, {', '.join(f"CASE WHEN reasons = '' THEN {c} END AS {c}" for c in ADDED)}, reasons FROM d""",
)
def add_passengers(passenger_requests):
    return requests.add_passengers(passenger_requests, AS_OF).summary


@check(
    "aircraft_requests fleet",
    f"""WITH t AS (SELECT request_id, trim(model) AS model, trim(registration) AS registration, capacity AS raw_capacity,
TRY_CAST(capacity AS INTEGER) AS capacity, status AS raw_status, coalesce(status, 'active') AS status FROM aircraft_requests),
c AS (SELECT t.*, {coded(("model = ''", 'model_required'), ("length(model) > 100", 'model_length'),
    ("registration = ''", 'registration_required'), ("length(registration) > 20", 'registration_length'),
    ("NOT regexp_matches(registration, '^[A-Z0-9-]+$')", 'registration_characters'),
    ("capacity IS NULL OR capacity NOT BETWEEN 1 AND 1000", 'capacity_range'),
    ("raw_status NOT IN ('active', 'maintenance', 'retired')", 'status_unknown'))} AS reasons FROM t),
{unique(['model', 'registration', 'capacity', 'status'], 'registration', 'SELECT registration FROM fleet', 'registration_taken')}""",
)
def create_aircraft(aircraft_requests, fleet):
    return requests.create_aircraft(aircraft_requests, fleet).summary


FLOWN = [
    "flight_number",
    "aircraft_id",
    "from_airport_code",
    "to_airport_code",
    "departure_datetime",
    "arrival_datetime",
    "base_price",
    "business_price",
    "first_class_price",
    "status",
]


@check(
    "flight_requests flights",
    f"""WITH t AS (SELECT request_id, flight_number, TRY_CAST(aircraft_id AS BIGINT) AS aircraft_id, from_airport_code, to_airport_code,
TRY_CAST(departure_datetime AS TIMESTAMP) AS departure_datetime, TRY_CAST(arrival_datetime AS TIMESTAMP) AS arrival_datetime,
CAST(base_price AS DECIMAL(10,2)) AS base_price,
CASE WHEN coalesce(CAST(business_price AS DECIMAL(10,2)), 0) = 0 THEN CAST(CAST(base_price AS DECIMAL(10,2)) * 1.5 AS DECIMAL(10,2)) ELSE CAST(business_price AS DECIMAL(10,2)) END AS business_price,
CASE WHEN coalesce(CAST(first_class_price AS DECIMAL(10,2)), 0) = 0 THEN CAST(CAST(base_price AS DECIMAL(10,2)) * 2 AS DECIMAL(10,2)) ELSE CAST(first_class_price AS DECIMAL(10,2)) END AS first_class_price,
coalesce(status, 'scheduled') AS status,
coalesce(flight_number, '') = '' OR coalesce(aircraft_id, '') = '' OR coalesce(to_airport_code, '') = '' OR base_price IS NULL AS missing
FROM flight_requests),
c AS (SELECT t.*, CASE WHEN departure_datetime IS NULL OR arrival_datetime IS NULL THEN 'invalid_date'
WHEN arrival_datetime <= departure_datetime THEN 'arrival_not_after_departure' ELSE '' END AS late FROM t),
w AS (SELECT flight_number, min(request_id) AS first_id FROM c WHERE NOT missing AND late = '' GROUP BY flight_number),
d AS (SELECT c.*, CASE WHEN missing THEN 'missing_fields'
WHEN c.flight_number IN (SELECT flight_number FROM flights) OR w.first_id < c.request_id THEN 'flight_number_taken' ELSE late END AS reasons
FROM c LEFT JOIN w ON w.flight_number = c.flight_number)
SELECT request_id, {', '.join(f"CASE WHEN reasons = '' THEN {c} END AS {c}" for c in FLOWN)}, reasons FROM d""",
)
def create_flights(flight_requests, flights):
    return requests.create_flights(flight_requests, flights).summary


ADMISSION = f"""free AS (SELECT f.flight_id, f.base_price, a.capacity - coalesce(s.n, 0) AS free
FROM flights f JOIN aircraft a ON f.aircraft_id = a.aircraft_id
LEFT JOIN (SELECT b.flight_id, count(*) AS n FROM {HELD} GROUP BY b.flight_id) s ON s.flight_id = f.flight_id
WHERE f.status IN ('scheduled', 'boarding')),
q AS (SELECT r.request_id, r.flight_id, r.n_seats, f.free,
row_number() OVER (PARTITION BY r.flight_id ORDER BY r.request_ts, r.request_id) AS place
FROM booking_requests r JOIN free f ON f.flight_id = r.flight_id),
walk AS (SELECT request_id, flight_id, place, n_seats <= free AS ok, CASE WHEN n_seats <= free THEN free - n_seats ELSE free END AS left_over
FROM q WHERE place = 1 UNION ALL
SELECT q.request_id, q.flight_id, q.place, q.n_seats <= w.left_over,
CASE WHEN q.n_seats <= w.left_over THEN w.left_over - q.n_seats ELSE w.left_over END
FROM walk w JOIN q ON q.flight_id = w.flight_id AND q.place = w.place + 1)"""
ADMITTED = """SELECT r.request_id, CASE WHEN w.ok THEN r.request_ts END AS request_ts, CASE WHEN w.ok THEN r.user_id END AS user_id,
CASE WHEN w.ok THEN r.flight_id END AS flight_id, CASE WHEN w.ok THEN 'economy' END AS class, CASE WHEN w.ok THEN r.n_seats END AS n_seats,
CASE WHEN w.ok THEN CAST(f.base_price * r.n_seats AS DECIMAL(12,2)) END AS total_amount,
CASE WHEN w.ok IS NULL THEN 'flight_not_available' WHEN w.ok THEN '' ELSE 'not_enough_seats' END AS reasons
FROM booking_requests r LEFT JOIN walk w ON w.request_id = r.request_id LEFT JOIN free f ON f.flight_id = r.flight_id"""


@check(
    "booking_requests flights aircraft bookings booking_passengers",
    f"WITH RECURSIVE {ADMISSION} {ADMITTED}",
)
def admit_bookings(booking_requests, flights, aircraft, bookings, booking_passengers):
    return admit(booking_requests, flights, aircraft, bookings, booking_passengers).summary


# Requests with their passengers, in all classes; the rows that the accepted ones leave in three tables.
FIRST_BOOKING, FIRST_PASSENGER, FIRST_LINK = 3_000_000_000, 4_000_000_000, 5_000_000_000
PERSON = (
    "transform(sequence(1, CAST(n_seats AS INT)), i -> named_struct("
    "'passenger_id', CASE WHEN (request_id + i) % 3 = 0 THEN user_id * 10 + i WHEN i = 2 THEN 0L END, "
    "'first_name', 'Ann', 'last_name', concat('Lee ', i), "
    "'date_of_birth', concat(1950 + (request_id + i) % 50, '-0', i, '-15'), "
    "'passport_number', CASE WHEN i % 2 = 0 THEN concat('X', request_id) ELSE '' END, "
    "'nationality', CASE WHEN i % 3 = 1 THEN 'Utopia' END, "
    "'seat_number', CASE WHEN i = 1 THEN '' ELSE concat(i, 'A') END, "
    "'save', CASE WHEN i < 5 THEN (request_id + i) % 2 = 0 END))"
)
NESTED = f"""r AS (SELECT *, CASE request_id % 4 WHEN 2 THEN 'business' WHEN 3 THEN 'first' ELSE 'economy' END AS class FROM booking_requests),
seats AS (SELECT b.flight_id, count(*) AS n FROM {HELD} GROUP BY b.flight_id),
sale AS (SELECT f.flight_id AS on_sale, a.capacity - coalesce(s.n, 0) AS free, unnest(['economy', 'business', 'first']) AS class,
unnest([base_price, business_price, first_class_price]) AS price
FROM flights f JOIN aircraft a ON f.aircraft_id = a.aircraft_id LEFT JOIN seats s ON s.flight_id = f.flight_id WHERE f.status IN ('scheduled', 'boarding')),
asked AS (SELECT r.*, on_sale, free, CAST(price * n_seats AS DECIMAL(12,2)) AS amount FROM r LEFT JOIN sale ON on_sale = r.flight_id AND sale.class = r.class),
q AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY request_ts, request_id) AS place FROM asked WHERE amount IS NOT NULL),
walk AS (SELECT request_id, flight_id, place, n_seats <= free AS ok, CASE WHEN n_seats <= free THEN free - n_seats ELSE free END AS rest
FROM q WHERE place = 1 UNION ALL SELECT q.request_id, q.flight_id, q.place, q.n_seats <= w.rest, CASE WHEN q.n_seats <= w.rest THEN w.rest - q.n_seats ELSE w.rest END
FROM walk w JOIN q ON q.flight_id = w.flight_id AND q.place = w.place + 1),
won AS (SELECT asked.* FROM asked JOIN walk ON walk.request_id = asked.request_id AND walk.ok),
people AS (SELECT *, row_number() OVER (ORDER BY request_id, i) - 1 AS number,
CASE WHEN (request_id + i) % 3 = 0 THEN user_id * 10 + i END AS known FROM (SELECT *, unnest(range(1, n_seats + 1)) AS i FROM won))"""
NESTED_TABLES = "booking_requests flights aircraft bookings booking_passengers"


def _nested(feed: DataFrame, *base: DataFrame) -> Outcome:
    flight_class = F.when(F.col("request_id") % 4 == 2, "business").when(F.col("request_id") % 4 == 3, "first")
    flight_class = flight_class.when(F.col("request_id") % 4 == 1, "economy")
    feed = feed.select("*", flight_class.alias("class"), F.expr(PERSON).alias("passengers")).drop("n_seats")
    return admit(feed, *base).stored("admitted")


def _scrambled(number: str) -> str:
    """Feistel rounds as SQL, and the digits of the result."""
    mask = (1 << HALF_BITS) - 1
    left, right = f"(({number} >> {HALF_BITS}) & {mask})", f"({number} & {mask})"
    for key in ROUND_KEYS:
        left, right = right, f"xor({left}, (({right} * {key} + {key}) >> {HALF_BITS // 2}) & {mask})"
    return f"(({left} << {HALF_BITS}) + {right})"


def _base36(number: str, digits: int) -> str:
    places = ", ".join(str(36**k) for k in reversed(range(digits)))
    digit = f"substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST({number} // p % 36 + 1 AS BIGINT), 1)"
    return f"array_to_string(list_transform([{places}], lambda p: {digit}), '')"


@check(
    NESTED_TABLES,
    f"""WITH RECURSIVE {NESTED} SELECT asked.request_id, CASE WHEN walk.ok THEN amount END AS total_amount,
CASE WHEN on_sale IS NULL THEN 'flight_not_available' WHEN amount IS NULL THEN 'no_price' WHEN walk.ok THEN '' ELSE 'not_enough_seats' END AS reasons
FROM asked LEFT JOIN walk ON walk.request_id = asked.request_id""",
)
def admit_nested_bookings(*given):
    return _nested(*given).summary.select("request_id", "total_amount", "reasons")


@check(
    NESTED_TABLES,
    f"""WITH RECURSIVE {NESTED} SELECT {FIRST_BOOKING} + request_id AS booking_id,
'BK' || {_base36("(epoch_us(request_ts) // 1000)", 8)} || {_base36(_scrambled("request_id"), 9)} AS booking_reference,
user_id, flight_id, request_ts AS booking_date, CAST(n_seats AS INTEGER) AS number_of_passengers, class, amount AS total_amount,
'confirmed' AS status, 'paid' AS payment_status, CAST(NULL AS VARCHAR) AS payment_method, request_ts AS created_at, request_ts AS updated_at FROM won""",
)
def admitted_bookings(*given):
    return admission.booking_rows(_nested(*given).accepted, FIRST_BOOKING)


@check(
    NESTED_TABLES,
    f"""WITH RECURSIVE {NESTED} SELECT {FIRST_PASSENGER} + number AS passenger_id, user_id, 'Ann' AS first_name, 'Lee ' || i AS last_name,
CAST((1950 + (request_id + i) % 50) || '-0' || i || '-15' AS DATE) AS date_of_birth, CASE WHEN i % 2 = 0 THEN 'X' || request_id END AS passport_number,
CASE WHEN i % 3 = 1 THEN 'Utopia' END AS nationality, CASE WHEN i < 5 AND (request_id + i) % 2 = 0 THEN 1 ELSE 0 END AS is_saved, request_ts AS created_at
FROM people WHERE known IS NULL""",
)
def admitted_passengers(*given):
    return admission.new_passenger_rows(_nested(*given).accepted, FIRST_PASSENGER)


@check(
    NESTED_TABLES,
    f"""WITH RECURSIVE {NESTED} SELECT {FIRST_LINK} + number AS booking_passenger_id, {FIRST_BOOKING} + request_id AS booking_id,
coalesce(known, {FIRST_PASSENGER} + number) AS passenger_id, CASE WHEN i > 1 THEN i || 'A' END AS seat_number FROM people""",
)
def admitted_links(*given):
    return admission.link_rows(_nested(*given).accepted, FIRST_BOOKING, FIRST_PASSENGER, FIRST_LINK)
