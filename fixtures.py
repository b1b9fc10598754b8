"""Test inputs: the airline tables and request feeds derived from the given parquet tables.

The same SQL text runs on both engines. Spark gets it with three substitutions (NTZ timestamp literals, table counts
as literals, the quoting of one name) and one table by a text of its own with the same rows; the oracle gets it as common
table expressions. Not part of the library.
"""

import re

from pyspark.sql import DataFrame, SparkSession

from tarmac.plans.session import broadcast_by_rows
from tarmac.schemas import TABLES, conform
from tarmac.sources.work import stored

RAW = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
        "o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
        "l_shipdate TIMESTAMP_NTZ"
    ),
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}

# Parameters every check uses.
AS_OF = "2001-07-15"
HOT_AS_OF = "2001-07-30"
NOW = "2001-07-30 12:00:00"

FIXTURES = {
    "airports": """
SELECT 'A' || CAST(n_nationkey AS STRING) AS airport_code, n_name AS airport_name,
  'CITY_' || CAST(n_nationkey % 20 AS STRING) AS city, r_name AS country
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "aircraft": """
SELECT p_partkey AS aircraft_id, p_name AS model, p_brand || '-' || CAST(p_partkey AS STRING) AS registration,
  6 + p_size AS capacity,
  CASE p_partkey % 10 WHEN 0 THEN 'retired' WHEN 1 THEN 'maintenance' ELSE 'active' END AS status,
  TIMESTAMP '2000-01-01 00:00:00' + INTERVAL '1' SECOND * (p_partkey * 977) AS created_at,
  TIMESTAMP '2001-01-01 00:00:00' + INTERVAL '1' SECOND * (p_partkey * 977) AS updated_at
FROM part""",
    # aircraft with registrations a request can spell, so that clashes with the base table occur
    "fleet": """
SELECT aircraft_id, model, upper(replace(registration, '#', '')) AS registration, capacity, status FROM aircraft""",
    "flights": """
SELECT p_partkey AS flight_id, 'FL' || CAST(p_partkey AS STRING) AS flight_number,
  (p_partkey * 6 + 3) % (SELECT count(*) FROM part) AS aircraft_id,
  'A' || CAST(p_partkey % 25 AS STRING) AS from_airport_code,
  'A' || CAST((p_partkey + 1 + (p_partkey * 3 + p_size) % 24) % 25 AS STRING) AS to_airport_code,
  TIMESTAMP '2001-07-25 06:00:00' + INTERVAL '1' SECOND * ((p_partkey * 2221) % 1728000) AS departure_datetime,
  TIMESTAMP '2001-07-25 06:00:00' + INTERVAL '1' SECOND * ((p_partkey * 2221) % 1728000 + 2700 + (p_size * 611) % 36000) AS arrival_datetime,
  CAST(p_retailprice AS DECIMAL(10,2)) AS base_price,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_retailprice * 1.5 AS DECIMAL(10,2)) END AS business_price,
  CAST(p_retailprice * 2 AS DECIMAL(10,2)) AS first_class_price,
  CASE p_partkey % 8 WHEN 0 THEN 'delayed' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'boarding' WHEN 3 THEN 'completed' ELSE 'scheduled' END AS status,
  TIMESTAMP '2000-01-01 00:00:00' + INTERVAL '1' SECOND * (p_partkey * 613) AS created_at,
  TIMESTAMP '2001-01-01 00:00:00' + INTERVAL '1' SECOND * (p_partkey * 613) AS updated_at
FROM part""",
    "users": """
SELECT c_custkey AS user_id, 'First' || CAST(c_custkey % 97 AS STRING) AS first_name, c_name AS last_name,
  lower(c_name) || '@example.com' AS email,
  CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role,
  CASE c_custkey % 20 WHEN 1 THEN 'inactive' WHEN 2 THEN 'suspended' ELSE 'active' END AS status,
  '+1 555 ' || CAST(c_custkey AS STRING) AS phone, DATE '1950-01-01' + CAST(c_custkey % 15000 AS INT) AS date_of_birth,
  CASE WHEN c_custkey % 3 > 0 THEN 'Street ' || CAST(c_custkey AS STRING) END AS address,
  TIMESTAMP '2000-01-01 00:00:00' + INTERVAL '1' SECOND * (c_custkey * 431) AS created_at,
  TIMESTAMP '2001-01-01 00:00:00' + INTERVAL '1' SECOND * (c_custkey * 431) AS updated_at
FROM customer""",
    "bookings": """
SELECT o_orderkey AS booking_id, 'BK' || CAST(100000 + o_orderkey AS STRING) AS booking_reference, o_custkey AS user_id,
  (o_orderkey * o_orderkey + o_custkey) % (SELECT count(*) FROM part) AS flight_id, o_orderdate AS booking_date,
  CASE o_orderkey % 4 WHEN 0 THEN 'business' WHEN 1 THEN 'first' ELSE 'economy' END AS class,
  CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount,
  CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'missed' ELSE 'confirmed' END
       WHEN o_orderstatus = 'O' THEN 'confirmed' WHEN o_orderkey % 2 = 0 THEN 'cancelled' ELSE 'pending' END AS status,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'refunded' WHEN o_orderpriority = '5-LOW' THEN 'pending' ELSE 'paid' END AS payment_status,
  CAST(1 + o_orderkey % 4 AS INT) AS number_of_passengers, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'cash' ELSE 'card' END AS payment_method,
  o_orderdate AS created_at, o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 1000) AS updated_at
FROM orders""",
    # numbered within each booking, so that no window runs over the whole table
    "booking_passengers": """
SELECT l_orderkey * 100000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS booking_passenger_id,
  l_orderkey AS booking_id, l_partkey AS passenger_id,
  CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_linenumber AS STRING) || 'C' END AS seat_number
FROM lineitem""",
    "passengers": """
SELECT p_partkey AS passenger_id, p_partkey % (SELECT count(*) FROM customer) AS user_id,
  split_part(p_name, ' ', 1) AS first_name,
  CASE WHEN p_partkey % 2 = 0 THEN upper(split_part(p_name, ' ', 2)) ELSE split_part(p_name, ' ', 2) END AS last_name,
  CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS is_saved, p_partkey AS created_seq,
  DATE '1950-01-01' + CAST(p_partkey % 15000 AS INT) AS date_of_birth,
  CASE WHEN p_partkey % 4 > 0 THEN 'P' || CAST(p_partkey AS STRING) END AS passport_number, p_brand AS nationality,
  TIMESTAMP '2000-01-01 00:00:00' + INTERVAL '1' SECOND * (p_partkey * 251) AS created_at
FROM part""",
    "check_ins": """
SELECT booking_id AS check_in_id, booking_id, CASE WHEN booking_id % 2 = 0 THEN 'completed' ELSE 'pending' END AS status
FROM bookings WHERE booking_id % 3 = 0""",
    "booking_requests": """
SELECT event_id AS request_id, ts AS request_ts, user_id,
  event_id % (SELECT CAST(ceil(count(*) / 40.0) AS BIGINT) FROM part) AS flight_id,
  1 + (event_id * 7 + user_id) % 5 AS n_seats
FROM events WHERE event_type = 'purchase'""",
    # searches that give any of the three fields, empty texts and unknown codes among them
    "search_requests": """
SELECT e.event_id AS search_id,
  CASE WHEN e.event_id % 10 < 9 THEN f.from_airport_code WHEN e.event_id % 20 = 9 THEN '' END AS from_code,
  CASE WHEN e.event_id % 70 = 3 THEN 'A99' WHEN e.user_id % 10 < 8 THEN f.to_airport_code WHEN e.user_id % 20 = 8 THEN '' END AS to_code,
  CASE WHEN (e.event_id + e.user_id) % 7 < 6 THEN CAST(f.departure_datetime AS DATE) END AS departure,
  CASE e.event_id % 6 WHEN 0 THEN '2 adults' WHEN 1 THEN '3' WHEN 2 THEN 'many' WHEN 3 THEN NULL ELSE '1' END AS passengers,
  CASE e.event_id % 5 WHEN 0 THEN 'business' WHEN 1 THEN 'first' WHEN 2 THEN 'cargo' WHEN 3 THEN NULL ELSE 'economy' END AS class
FROM events e JOIN flights f ON f.flight_id = (e.event_id * 13 + e.user_id) % (SELECT count(*) FROM part)
WHERE e.event_type = 'signup'""",
    # parts of flight numbers, cities and airport names, in any case, with wildcards that are none, and blanks
    "text_searches": """
SELECT e.event_id AS search_id,
  CASE WHEN e.event_id % 50 = 0 THEN substr(a.airport_name, 2, 5) WHEN e.event_id % 50 = 1 THEN ' ' || lower(a.airport_name) || ' '
    WHEN e.event_id % 50 = 2 THEN a.city WHEN e.event_id % 50 = 3 THEN substr(f.flight_number, 3, 2) WHEN e.event_id % 50 = 4 THEN 'f%1'
    WHEN e.event_id % 50 = 5 THEN 'zzz' WHEN e.event_id % 1000 = 6 THEN ' ' WHEN e.event_id % 1000 = 56 THEN NULL WHEN e.event_id % 1000 = 106 THEN '7'
    ELSE lower(f.flight_number) END AS search
FROM events e JOIN flights f ON f.flight_id = (e.event_id * 17 + e.user_id) % (SELECT count(*) FROM part)
JOIN airports a ON a.airport_code = f.to_airport_code WHERE e.event_type = 'error'""",
    "booking_changes": """
SELECT e.event_id AS change_id, e.ts AS change_ts, b.booking_id,
  CASE WHEN e.event_id % 4 = 0 THEN -1 ELSE b.user_id END AS requester_id,
  CASE e.event_type WHEN 'click' THEN 'cancel' WHEN 'view' THEN 'user_status' ELSE 'admin_status' END AS op,
  CASE e.event_type WHEN 'view' THEN CASE e.event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'missed' ELSE 'cancelled' END
    WHEN 'signup' THEN CASE e.event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'completed' ELSE 'bogus' END END AS status,
  CASE WHEN e.event_type = 'signup' AND e.event_id % 2 = 0 THEN 'paid' END AS payment_status
FROM events e JOIN bookings b ON b.booking_id = (e.user_id * 7) % (SELECT count(*) FROM orders)
WHERE e.event_type IN ('click', 'view', 'signup')""",
    "checkin_requests": """
SELECT e.event_id AS request_id, b.booking_reference AS booking_reference,
  CASE WHEN e.event_id % 16 = 0 THEN -1 ELSE b.user_id END AS user_id,
  CASE WHEN e.event_id % 13 = 0 THEN 'nobody' ELSE lower(p.last_name) END AS last_name
FROM events e JOIN bookings b ON b.booking_id = (e.event_id * 17) % (SELECT count(*) FROM orders)
JOIN (SELECT booking_id, min(passenger_id) AS pid FROM booking_passengers GROUP BY booking_id) m ON m.booking_id = b.booking_id
JOIN passengers p ON p.passenger_id = m.pid
UNION ALL
SELECT event_id + 1000000, CASE WHEN event_id % 100 = 0 THEN 'BKZZZ' ELSE 'bad ref' END, 1, 'ring' FROM events WHERE event_id % 50 = 0""",
    "registrations": """
SELECT c_custkey AS request_id,
  CASE WHEN c_custkey % 31 = 0 THEN 'X' WHEN c_custkey % 37 = 0 THEN 'Bad1' ELSE 'Ann' END AS first_name,
  'O''Neil' AS last_name,
  CASE WHEN c_custkey % 29 = 0 THEN 'not-an-email' WHEN c_custkey % 5 = 0 THEN lower(c_name) || '@example.com'
       WHEN c_custkey % 7 = 0 THEN 'dup' || CAST(c_custkey % 10 AS STRING) || '@example.com'
       ELSE ' New' || CAST(c_custkey AS STRING) || '@Example.com ' END AS email,
  CASE WHEN c_custkey % 23 = 0 THEN 'weakpass' ELSE 'Passw0rd' END AS password,
  CASE WHEN c_custkey % 43 = 0 THEN 'Passw0rd!' WHEN c_custkey % 23 = 0 THEN 'weakpass' ELSE 'Passw0rd' END AS confirm_password,
  CASE WHEN c_custkey % 19 = 0 THEN 'call me' ELSE '+1 (555) 010-0000' END AS phone,
  CASE WHEN c_custkey % 17 = 0 THEN '1850-01-01' WHEN c_custkey % 41 = 0 THEN '2001-13-45' ELSE '1980-02-29' END AS dob
FROM customer""",
    "passenger_requests": """
SELECT p_partkey AS request_id, p_partkey % (SELECT count(*) FROM customer) AS user_id,
  CASE WHEN p_partkey % 31 = 0 THEN 'X' WHEN p_partkey % 37 = 0 THEN 'Bad1' WHEN p_partkey % 59 = 0 THEN NULL ELSE ' Ann ' END AS first_name,
  split_part(p_name, ' ', 2) AS last_name,
  CASE WHEN p_partkey % 17 = 0 THEN '1850-01-01' WHEN p_partkey % 41 = 0 THEN '2001-13-45' WHEN p_partkey % 5 = 0 THEN NULL ELSE '1980-02-29' END AS date_of_birth,
  CASE WHEN p_partkey % 43 = 0 THEN repeat('9', 51) WHEN p_partkey % 2 = 0 THEN 'P' || CAST(p_partkey AS STRING) END AS passport_number,
  CASE WHEN p_partkey % 47 = 0 THEN repeat('n', 101) ELSE 'Testland' END AS nationality
FROM part""",
    "aircraft_requests": """
SELECT p_partkey AS request_id,
  CASE WHEN p_partkey % 29 = 0 THEN '' WHEN p_partkey % 53 = 0 THEN repeat('m', 101) ELSE p_name END AS model,
  CASE WHEN p_partkey % 7 = 0 THEN 'low-' || CAST(p_partkey AS STRING)
       WHEN p_partkey % 11 = 0 THEN upper(replace(p_brand, '#', '')) || '-' || CAST(p_partkey AS STRING)
       WHEN p_partkey % 13 = 0 THEN 'DUP-' || CAST(p_partkey % 10 AS STRING)
       ELSE ' NEW-' || CAST(p_partkey AS STRING) END AS registration,
  CASE WHEN p_partkey % 17 = 0 THEN '0' WHEN p_partkey % 19 = 0 THEN '1001' WHEN p_partkey % 23 = 0 THEN 'abc' ELSE CAST(6 + p_size AS STRING) END AS capacity,
  CASE WHEN p_partkey % 31 = 0 THEN 'broken' WHEN p_partkey % 3 = 0 THEN NULL ELSE 'maintenance' END AS status
FROM part""",
    "flight_requests": """
SELECT p_partkey AS request_id,
  CASE WHEN p_partkey % 29 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN 'FL' || CAST(p_partkey AS STRING)
       WHEN p_partkey % 5 = 0 THEN 'DUP' || CAST(p_partkey % 40 AS STRING) ELSE 'NF' || CAST(p_partkey AS STRING) END AS flight_number,
  CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE CAST(p_partkey AS STRING) END AS aircraft_id,
  'A' || CAST(p_partkey % 25 AS STRING) AS from_airport_code,
  CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE 'A' || CAST((p_partkey + 1) % 25 AS STRING) END AS to_airport_code,
  CASE WHEN p_partkey % 19 = 0 THEN 'soon' ELSE '2001-09-01 10:00:00' END AS departure_datetime,
  CASE WHEN p_partkey % 10 = 0 THEN '2001-09-01 10:00:00' WHEN p_partkey % 23 = 0 THEN '2001-09-01 09:59:59' ELSE '2001-09-01 12:30:00' END AS arrival_datetime,
  CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE CAST(CAST(p_retailprice + 0.01 * (p_partkey % 7) AS DECIMAL(10,2)) AS STRING) END AS base_price,
  CASE WHEN p_partkey % 3 = 0 THEN '0' WHEN p_partkey % 3 = 1 THEN NULL ELSE '1234.56' END AS business_price,
  CASE WHEN p_partkey % 4 = 0 THEN '4321.10' END AS first_class_price,
  CASE WHEN p_partkey % 6 = 0 THEN 'boarding' END AS status
FROM part""",
    "user_status_requests": """
SELECT event_id AS change_id, ts AS change_ts,
  CASE WHEN event_id % 9 = 0 THEN (user_id * 7) % (SELECT count(*) FROM customer) ELSE 0 END AS admin_id,
  CASE WHEN event_id % 11 = 0 THEN -1 ELSE (user_id * 7) % (SELECT count(*) FROM customer) END AS user_id,
  CASE event_id % 5 WHEN 0 THEN 'inactive' WHEN 1 THEN 'suspended' WHEN 2 THEN 'bogus' ELSE 'active' END AS status
FROM events""",
    # partial updates as (flag, value) pairs; the Spark side folds them into a map, absent where the flag is 0
    "profile_feed": """
SELECT event_id AS change_id, ts AS change_ts, CASE WHEN event_id % 101 = 0 THEN -5 ELSE user_id END AS user_id,
  CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS has_first_name,
  CASE WHEN event_id % 38 = 0 THEN '' ELSE 'Ann' || substring('abcdefghij', CAST(1 + event_id % 10 AS INT), 1) END AS first_name,
  CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS has_email,
  CASE WHEN event_id % 45 = 0 THEN 'nope' WHEN event_id % 9 = 0 THEN 'Shared' || CAST(event_id % 200 AS STRING) || '@example.com'
       WHEN event_id % 6 = 0 THEN 'customer#' || lpad(CAST(user_id AS STRING), 9, '0') || '@example.com'
       ELSE 'customer#' || lpad(CAST(event_id % 300 AS STRING), 9, '0') || '@example.com' END AS email,
  CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS has_address,
  CASE WHEN event_id % 14 = 0 THEN '' WHEN event_id % 21 = 0 THEN NULL ELSE 'Street ' || CAST(event_id AS STRING) END AS address
FROM events""",
    "aircraft_feed": """
SELECT event_id AS change_id, ts AS change_ts, CASE WHEN event_id % 97 = 0 THEN -5 ELSE event_id % (SELECT count(*) FROM part) END AS aircraft_id,
  CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS has_model,
  CASE WHEN event_id % 34 = 0 THEN '' ELSE 'Model ' || CAST(event_id AS STRING) END AS model,
  CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS has_registration,
  CASE WHEN event_id % 33 = 0 THEN 'bad reg' ELSE 'REG-' || CAST(event_id % 777 AS STRING) END AS registration,
  CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS has_capacity,
  CASE WHEN event_id % 55 = 0 THEN '1001' ELSE CAST(1 + event_id % 400 AS STRING) END AS capacity
FROM events""",
    "flight_feed": """
SELECT event_id AS change_id, ts AS change_ts, CASE WHEN event_id % 97 = 0 THEN -5 ELSE event_id % (SELECT count(*) FROM part) END AS flight_id,
  CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS has_flight_number,
  CASE WHEN event_id % 22 = 0 THEN '' WHEN event_id % 6 = 0 THEN 'FL' || CAST(event_id % 400 AS STRING) ELSE 'NX' || CAST(event_id % 900 AS STRING) END AS flight_number,
  CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS has_times,
  '2001-10-01 08:00:00' AS departure_datetime,
  CASE WHEN event_id % 12 = 0 THEN '2001-10-01 08:00:00' ELSE '2001-10-01 11:15:00' END AS arrival_datetime,
  CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS has_base_price,
  CASE WHEN event_id % 10 = 0 THEN '0' ELSE '777.25' END AS base_price
FROM events""",
    # names that differ in case and accents alone
    "accented_airports": """
SELECT airport_code, airport_name, country, CASE CAST(substr(airport_code, 2) AS INT) % 3 WHEN 0 THEN 'Córdoba ' WHEN 1 THEN 'CORDOBA ' ELSE 'cordobá ' END
  || CAST(CAST(substr(airport_code, 2) AS INT) % 8 AS STRING) AS city FROM airports""",
    "accented_users": """
SELECT user_id, first_name, last_name, CASE user_id % 3 WHEN 0 THEN upper(email) WHEN 1 THEN replace(email, 'example', 'exámple') ELSE email END AS email,
  role, status, phone, date_of_birth, address, created_at, updated_at FROM users""",
    "accented_passengers": """
SELECT passenger_id, user_id, first_name, CASE passenger_id % 3 WHEN 0 THEN translate(last_name, 'aeiouAEIOU', 'áèîöüÁÈÎÖÜ') ELSE last_name END AS last_name,
  date_of_birth, passport_number, nationality FROM passengers""",
    # JSON bodies in which every field is absent, null, empty or given, as text, number, truth value, object or list
    "profile_bodies": """
SELECT event_id AS change_id, ts AS change_ts, CASE WHEN event_id % 103 = 0 THEN -5 ELSE user_id END AS user_id,
  CASE event_id % 101 WHEN 7 THEN '{"firstName":' WHEN 8 THEN '[1]' WHEN 9 THEN NULL ELSE
    '{' || concat_ws(',', CASE event_id % 11 WHEN 0 THEN '"firstName":null' WHEN 1 THEN '"firstName":""' WHEN 2 THEN '"firstName":" Ann "' WHEN 3 THEN '"firstName":"Zoe"' WHEN 4 THEN '"firstName":"B0b"' WHEN 5 THEN '"firstName":"Eve"' WHEN 6 THEN '"firstName":"Kim"' END,
    CASE event_id % 13 WHEN 0 THEN '"lastName":null' WHEN 1 THEN '"lastName":""' WHEN 2 THEN '"lastName":"Lee"' WHEN 3 THEN '"lastName":"O-Neil "' WHEN 4 THEN '"lastName":7' WHEN 5 THEN '"lastName":"Ray"' END,
    CASE event_id % 17 WHEN 0 THEN '"email":null' WHEN 1 THEN '"email":""' WHEN 2 THEN '"email":"nope"' WHEN 3 THEN '"email":"Shared' || CAST(event_id % 40 AS STRING) || '@example.com"'
      WHEN 4 THEN '"email":" customer#' || lpad(CAST(event_id % 300 AS STRING), 9, '0') || '@example.com"' WHEN 5 THEN '"email":"own' || CAST(event_id AS STRING) || '@example.com"' END,
    CASE event_id % 19 WHEN 0 THEN '"phone":null' WHEN 1 THEN '"phone":""' WHEN 2 THEN '"phone":"+1 555"' WHEN 3 THEN '"phone":5550100' WHEN 4 THEN '"phone":"call me"' WHEN 5 THEN '"phone":"+44 (20) 7"' END,
    CASE event_id % 23 WHEN 0 THEN '"dateOfBirth":null' WHEN 1 THEN '"dateOfBirth":""' WHEN 2 THEN '"dateOfBirth":"1980-02-29"' WHEN 3 THEN '"dateOfBirth":"2001-13-45"' WHEN 4 THEN '"dateOfBirth":"1850-01-01"' WHEN 5 THEN '"dateOfBirth":19800229' WHEN 6 THEN '"dateOfBirth":"1999-12-31"' END,
    CASE event_id % 5 WHEN 0 THEN '"address":null' WHEN 1 THEN '"address":""' WHEN 2 THEN '"address":"Street 5"' WHEN 3 THEN '"address":12' END,
    CASE WHEN event_id % 19 > 5 AND event_id % 29 = 3 THEN '"phone":{"home":1}' WHEN event_id % 29 = 4 THEN '"spare":[1]' END) || '}' END AS body
FROM events""",
    "aircraft_bodies": """
SELECT event_id AS change_id, ts AS change_ts, CASE WHEN event_id % 97 = 0 THEN -5 ELSE event_id % (SELECT count(*) FROM part) END AS aircraft_id,
  CASE event_id % 101 WHEN 7 THEN '{' WHEN 8 THEN '[1]' WHEN 9 THEN NULL ELSE
    '{' || concat_ws(',', CASE event_id % 7 WHEN 0 THEN '"model":null' WHEN 1 THEN '"model":""' WHEN 2 THEN '"model":"Model Q "' WHEN 3 THEN '"model":320' END,
    CASE event_id % 11 WHEN 0 THEN '"registration":null' WHEN 1 THEN '"registration":""' WHEN 2 THEN '"registration":"bad reg"' WHEN 3 THEN '"registration":" NR-' || CAST(event_id % 50 AS STRING) || '"'
      WHEN 4 THEN '"registration":["X"]' WHEN 5 THEN '"registration":"QX-' || CAST(event_id AS STRING) || '"' END,
    CASE event_id % 13 WHEN 0 THEN '"capacity":null' WHEN 1 THEN '"capacity":""' WHEN 2 THEN '"capacity":150' WHEN 3 THEN '"capacity":"99"' WHEN 4 THEN '"capacity":"1001"' WHEN 5 THEN '"capacity":12.5' WHEN 6 THEN '"capacity":true' WHEN 7 THEN '"capacity":0' END,
    CASE event_id % 17 WHEN 0 THEN '"status":null' WHEN 1 THEN '"status":""' WHEN 2 THEN '"status":"active"' WHEN 3 THEN '"status":"retired"' WHEN 4 THEN '"status":"maintenance"' WHEN 5 THEN '"status":"lost"' END) || '}' END AS body
FROM events""",
    "flight_bodies": """
SELECT event_id AS change_id, ts AS change_ts, CASE WHEN event_id % 97 = 0 THEN -5 ELSE event_id % (SELECT count(*) FROM part) END AS flight_id,
  CASE event_id % 101 WHEN 7 THEN 'nul' WHEN 8 THEN '[1]' WHEN 9 THEN NULL ELSE
    '{' || concat_ws(',', CASE event_id % 7 WHEN 0 THEN '"flight_number":null' WHEN 1 THEN '"flight_number":""' WHEN 2 THEN '"flight_number":"0"' WHEN 3 THEN '"flight_number":0'
      WHEN 4 THEN '"flight_number":"NX' || CAST(event_id % 900 AS STRING) || '"' END,
    CASE event_id % 11 WHEN 0 THEN '"aircraft_id":null' WHEN 1 THEN '"aircraft_id":""' WHEN 2 THEN '"aircraft_id":12' WHEN 3 THEN '"aircraft_id":"7abc"' WHEN 4 THEN '"aircraft_id":0' WHEN 5 THEN '"aircraft_id":"none"' WHEN 6 THEN '"aircraft_id":false' END,
    CASE event_id % 13 WHEN 0 THEN '"from_airport_code":null' WHEN 1 THEN '"from_airport_code":""' WHEN 2 THEN '"from_airport_code":"A3"' WHEN 3 THEN '"from_airport_code":0' WHEN 4 THEN '"from_airport_code":"A4"' END,
    CASE event_id % 17 WHEN 0 THEN '"to_airport_code":null' WHEN 1 THEN '"to_airport_code":""' WHEN 2 THEN '"to_airport_code":"A5"' WHEN 3 THEN '"to_airport_code":false' WHEN 4 THEN '"to_airport_code":"A6"' END,
    CASE event_id % 5 WHEN 0 THEN '"departure_datetime":null' WHEN 1 THEN '"departure_datetime":""' WHEN 2 THEN '"departure_datetime":"2001-10-01 08:00:00"' END,
    CASE event_id % 10 WHEN 0 THEN '"arrival_datetime":null' WHEN 1 THEN '"arrival_datetime":""' WHEN 2 THEN '"arrival_datetime":"2001-10-01 08:00:00"' WHEN 7 THEN '"arrival_datetime":"2001-10-01 11:15:00"' WHEN 9 THEN '"arrival_datetime":"2001-10-02 00:00:00"' END,
    CASE event_id % 19 WHEN 0 THEN '"status":null' WHEN 1 THEN '"status":""' WHEN 2 THEN '"status":"boarding"' WHEN 3 THEN '"status":0' WHEN 4 THEN '"status":"delayed"' END,
    CASE event_id % 23 WHEN 0 THEN '"base_price":null' WHEN 1 THEN '"base_price":""' WHEN 2 THEN '"base_price":0' WHEN 3 THEN '"base_price":12.5' WHEN 4 THEN '"base_price":"777.25"' WHEN 5 THEN '"base_price":"12.345"' WHEN 6 THEN '"base_price":"abc"' WHEN 7 THEN '"base_price":true' END,
    CASE event_id % 29 WHEN 0 THEN '"business_price":null' WHEN 1 THEN '"business_price":""' WHEN 2 THEN '"business_price":0' WHEN 3 THEN '"business_price":1500' WHEN 4 THEN '"business_price":"88.8"' END,
    CASE event_id % 31 WHEN 0 THEN '"first_class_price":null' WHEN 1 THEN '"first_class_price":""' WHEN 2 THEN '"first_class_price":"0"' WHEN 3 THEN '"first_class_price":2500.75' END,
    CASE WHEN event_id % 37 = 5 THEN '"seats":{"a":1}' END) || '}' END AS body
FROM events""",
    "flight_deletes": """
SELECT event_id AS request_id, event_id % (SELECT 2 * count(*) FROM part) AS flight_id FROM events""",
    "aircraft_deletes": """
SELECT event_id AS request_id, event_id % (SELECT 2 * count(*) FROM part) AS aircraft_id FROM events""",
    "confirm_feed": """
SELECT e.event_id AS request_id, b.booking_id, CASE WHEN e.event_id % 16 = 0 THEN -1 ELSE b.user_id END AS user_id,
  m.n + CASE WHEN e.event_id % 13 = 0 THEN 1 ELSE 0 END AS n_seats,
  CASE WHEN e.event_id % 19 = 0 THEN '  ' ELSE ' a' END AS seat_suffix,
  CASE e.event_id % 7 WHEN 0 THEN 'GATE-TOO-LONG' WHEN 1 THEN NULL ELSE 'G' || CAST(e.event_id % 30 AS STRING) END AS gate_number
FROM events e JOIN bookings b ON b.booking_id = (e.event_id * 17) % (SELECT count(*) FROM orders)
JOIN (SELECT booking_id, count(*) AS n FROM booking_passengers GROUP BY booking_id) m ON m.booking_id = b.booking_id""",
}

# The window apart from the other columns: its exchange then moves only what it reads, and the rows still lie by booking
# behind it, where Spark loses sight of that if the booking is renamed below the window.
ON_SPARK = {
    "booking_passengers": """
SELECT l_orderkey * 100000 + place AS booking_passenger_id, l_orderkey AS booking_id, l_partkey AS passenger_id,
  CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_linenumber AS STRING) || 'C' END AS seat_number
FROM (SELECT l_orderkey, l_partkey, l_linenumber,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS place
FROM lineitem)"""
}

# Feeds that joins make up; they are stored first, as requests come in a table and are not computed for every use.
JOINED_FEEDS = ("checkin_requests", "confirm_feed", "search_requests", "text_searches")

_COUNT = re.compile(r"\(SELECT (CAST\(ceil\(count\(\*\) / 40\.0\) AS BIGINT\)|2 \* count\(\*\)|count\(\*\)) FROM (\w+)\)")
_counts: dict[tuple[str, str], int] = {}


def _needed(sql: str, found: dict[str, None]) -> dict[str, None]:
    """Names of the fixture and raw tables ``sql`` reads, dependencies first."""
    for name in re.findall(r"(?:FROM|JOIN)\s+\(?(\w+)", sql):
        if name in FIXTURES and name not in found:
            _needed(FIXTURES[name], found)
            found[name] = None
        elif name in RAW:
            found[name] = None
    return found


def _count(spark: SparkSession, sf_dir: str, table: str) -> int:
    key = (sf_dir, table)
    if key not in _counts:
        _counts[key] = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    return _counts[key]


def _spark_text(spark: SparkSession, sf_dir: str, sql: str) -> str:
    def literal(match):
        n = _count(spark, sf_dir, match.group(2))
        if "ceil" in match.group(1):
            n = -(-n // 40)
        elif match.group(1).startswith("2"):
            n = 2 * n
        return f"{n}L"

    return _COUNT.sub(literal, sql).replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace("'O''Neil'", '"O\'Neil"')


def _raw_view(spark: SparkSession, sf_dir: str, name: str) -> str:
    view = re.sub(r"\W", "_", f"given{sf_dir}_{name}")
    if not spark.catalog.tableExists(view):
        spark.read.schema(RAW[name]).parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(view)
    return view


def _derived(spark: SparkSession, sf_dir: str, name: str, **views: str) -> DataFrame:
    parts = []
    for needed in _needed(f"FROM {name}", {}):
        if needed in RAW:
            body = f"SELECT * FROM {views.get(needed) or _raw_view(spark, sf_dir, needed)}"
        else:
            body = _spark_text(spark, sf_dir, ON_SPARK.get(needed, FIXTURES[needed]))
        parts.append(f"{needed} AS ({body})")
    return spark.sql(f"WITH {', '.join(parts)} SELECT * FROM {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture table or feed ``name`` as a DataFrame over the parquet files in ``sf_dir``."""
    df = _derived(spark, sf_dir, name)
    if name in JOINED_FEEDS:
        with broadcast_by_rows(spark):
            return stored(df, name.replace("_", "-"))
    return conform(df, name) if name in TABLES else df


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, name) for name in names]


def oracle(sql: str) -> str:
    """``sql`` (which may start with its own WITH) prefixed with the fixtures it reads."""
    body = sql.strip()
    parts = [f"{n} AS ({FIXTURES[n].strip()})" for n in _needed(body, {}) if n not in RAW]
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join([*parts, body.removeprefix('WITH RECURSIVE ')])}"
    if body.startswith("WITH "):
        return f"WITH {', '.join([*parts, body.removeprefix('WITH ')])}"
    return f"WITH {', '.join(parts)}\n{body}" if parts else body


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The feed ``name`` as a stream over the events file; the other tables it reads are static."""
    arriving = spark.readStream.schema(RAW["events"]).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    arriving.createOrReplaceTempView("arriving_events")
    return _derived(spark, sf_dir, name, events="arriving_events")
