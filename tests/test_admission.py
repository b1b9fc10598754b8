"""Seat admission against a plain loop over the requests, in batch and as a stream."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rows import frame, reasons, table, ts
from tarmac.operators import admission
from tarmac.streaming.admission import accepted_requests, admit_available

REQUEST = "request_id BIGINT, request_ts TIMESTAMP_NTZ, user_id BIGINT, flight_id BIGINT, class STRING, n_seats BIGINT"
COLUMNS = [c.split(" ")[0] for c in REQUEST.split(", ")]


def make(seed, flights=12, count=1500, hot=0.4):
    """Requests of which a large share goes to one flight, with ties in time; capacities 0 to 60."""
    rng = random.Random(seed)
    capacity = {f: rng.randrange(0, 60) for f in range(flights)}
    capacity[0] = 60
    requests = []
    for i in range(count):
        f = 0 if rng.random() < hot else rng.randrange(flights)
        requests.append((i, ts(f"2001-07-{rng.randrange(1, 4):02d} 00:00:{rng.randrange(60):02d}"), 1, f, "economy", rng.randrange(1, 9)))
    rng.shuffle(requests)
    return capacity, requests


def in_order(capacity, requests, left=None):
    left = dict(capacity) if left is None else left
    accepted = set()
    for r in sorted(requests, key=lambda r: (r[1], r[0])):
        if r[5] <= left[r[3]]:
            left[r[3]] -= r[5]
            accepted.add(r[0])
    return accepted, left


def base(spark, capacity):
    flights = table(
        spark,
        "flights",
        *[{"flight_id": f, "aircraft_id": f, "status": "scheduled", "base_price": 10 + f} for f in capacity],
    )
    aircraft = table(spark, "aircraft", *[{"aircraft_id": f, "capacity": c} for f, c in capacity.items()])
    return flights, aircraft, table(spark, "bookings"), table(spark, "booking_passengers")


def feed(spark, requests):
    return frame(spark, REQUEST, [dict(zip(COLUMNS, r, strict=True)) for r in requests])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_one_after_the_other(spark, seed):
    capacity, requests = make(seed)
    outcome = admission.admit_bookings(feed(spark, requests).repartition(5), *base(spark, capacity)).decided
    got = {r.request_id: r for r in outcome.collect()}
    expected, left = in_order(capacity, requests)
    assert {i for i, r in got.items() if not r.reasons} == expected
    assert len(got) == len(requests) and min(left.values()) >= 0
    assert all(got[i].total_amount == got[i].n_seats * (10 + got[i].flight_id) for i in expected)
    size = {r[0]: r[5] for r in requests}
    used = Counter()
    for i in expected:
        used[got[i].flight_id] += size[i]
    assert all(used[f] <= capacity[f] for f in capacity)


def test_result_does_not_depend_on_partitions(spark):
    capacity, requests = make(4, count=600)
    tables = base(spark, capacity)
    one = admission.admit_bookings(feed(spark, requests).coalesce(1), *tables).accepted
    many = admission.admit_bookings(feed(spark, requests[::-1]).repartition(17), *tables).accepted
    assert sorted(one.collect()) == sorted(many.collect())


def test_the_cut_leaves_few_requests(spark):
    """A flight with r free seats keeps at most the sum of r // n requests, however many ask."""
    requests = [(i, ts("2001-07-01 00:00:00"), 1, 0, "economy", 1 + i % 5) for i in range(4000)]
    flights, aircraft, bookings, people = base(spark, {0: 10})
    asked = admission.priced(feed(spark, requests).join(admission.free_seats(flights, aircraft, bookings, people), "flight_id", "left"))
    queue = asked.where(F.size("reasons") == 0)
    cut = admission._first_of_each_size(queue)
    assert cut.count() == sum(10 // n for n in range(1, 6))
    assert [r.request_id for r in admission.admitted_ids(asked).collect()] == [0, 1, 2, 3]


def test_reasons(spark):
    capacity = {1: 5, 2: 5, 3: 5}
    flights, aircraft, _, _ = base(spark, capacity)
    flights = flights.withColumn("status", F.when(F.col("flight_id") == 2, "delayed").otherwise("boarding"))
    bookings = table(
        spark,
        "bookings",
        {"booking_id": 1, "flight_id": 1, "status": "pending"},
        {"booking_id": 2, "flight_id": 1, "status": "cancelled"},
        {"booking_id": 3, "flight_id": 3, "status": "confirmed"},
    )
    people = table(spark, "booking_passengers", *[{"booking_id": b} for b in (1, 1, 1, 2, 3, 3, 3, 3, 3, 3)])
    at = ts("2001-07-01 00:00:00")
    requests = [
        (1, at, 1, 1, "economy", 3),
        (2, at, 1, 1, None, 2),
        (3, at, 1, 1, "economy", 1),
        (4, at, 1, 2, "economy", 1),
        (5, at, 1, 9, "economy", 1),
        (6, at, 1, None, "economy", 1),
        (7, at, 1, 1, "economy", 0),
        (8, at, 1, 1, "economy", None),
        (9, at, 1, 1, "business", 1),
        (10, at, 1, 3, "economy", 1),
    ]
    outcome = admission.admit_bookings(feed(spark, requests), flights, aircraft, bookings, people)
    assert reasons(outcome.decided) == {
        1: ["not_enough_seats"],
        2: [],
        3: ["not_enough_seats"],
        4: ["flight_not_available"],
        5: ["flight_not_available"],
        6: ["flight_and_passengers_required"],
        7: ["flight_and_passengers_required"],
        8: ["flight_and_passengers_required"],
        9: ["no_price"],
        10: ["not_enough_seats"],
    }


def test_new_rows(spark):
    person = (
        "struct<passenger_id: bigint, first_name: string, last_name: string, date_of_birth: string, "
        "passport_number: string, nationality: string, seat_number: string, save: boolean>"
    )
    requests = spark.sql(
        f"""SELECT 5L AS request_id, TIMESTAMP_NTZ '2001-07-01 10:00:00' AS request_ts, 7L AS user_id, 1L AS flight_id,
        from_json('[{{"passenger_id": 42, "seat_number": "1A"}},
        {{"first_name": "Ann", "last_name": "Lee", "date_of_birth": "1990-01-02", "nationality": "", "save": true}}]',
        'array<{person}>') AS passengers UNION ALL
        SELECT 6L, TIMESTAMP_NTZ '2001-07-01 10:00:00', 7L, 1L, from_json('[]', 'array<{person}>')"""
    )
    outcome = admission.admit_bookings(requests, *base(spark, {1: 2}))
    assert reasons(outcome.decided) == {5: [], 6: ["flight_and_passengers_required"]}
    accepted = outcome.accepted
    (booking,) = admission.booking_rows(accepted, 1000).collect()
    assert (booking.booking_id, booking.number_of_passengers, booking.status, booking.payment_status) == (1005, 2, "confirmed", "paid")
    assert booking.total_amount == 22 and booking["class"] == "economy"
    assert 5 <= len(booking.booking_reference) <= 20 and booking.booking_reference.isalnum()
    assert booking.booking_reference.startswith("BK") and booking.booking_reference == booking.booking_reference.upper()
    (new,) = admission.new_passenger_rows(accepted, 10**6).collect()
    assert (new.user_id, new.first_name, new.is_saved, new.nationality) == (7, "Ann", 1, None)
    links = sorted(admission.link_rows(accepted, 1000, 10**6, 10**7).collect())
    assert [(r.booking_id, r.passenger_id, r.seat_number) for r in links] == [(1005, 42, "1A"), (1005, new.passenger_id, None)]
    assert len({r.booking_passenger_id for r in links}) == 2


def test_stream_carries_seats_from_batch_to_batch(spark, tmp_path):
    """Three arrivals, each in an order of its own; the later ones meet the seats the earlier ones left."""
    capacity, requests = make(5, count=900)
    free = admission.free_seats(*base(spark, capacity))
    source, left, expected = tmp_path / "requests", None, set()
    schema = feed(spark, []).schema
    for arrival in range(3):
        part = requests[arrival::3]
        feed(spark, part).repartition(3).write.mode("append").parquet(str(source))
        accepted, left = in_order(capacity, part, left)
        expected |= accepted
        decided = admit_available(spark.readStream.schema(schema).parquet(str(source)), free, str(tmp_path / "out"))
    rows = decided.collect()
    assert len(rows) == len(requests) and {r.request_id for r in rows} == set(range(900))
    assert {r.request_id for r in rows if r.reason == ""} == expected
    full = accepted_requests(decided, feed(spark, requests), free).collect()
    assert {r.request_id: r.total_amount for r in full} == {r[0]: r[5] * (10 + r[3]) for r in requests if r[0] in expected}


def test_passengers_of_large_requests_get_ids_of_their_own(spark):
    people = "transform(sequence(1, n), x -> named_struct('passenger_id', CAST(null AS BIGINT), 'first_name', 'A', "
    people += "'last_name', 'B', 'date_of_birth', '2000-01-01', 'passport_number', '', 'nationality', '', "
    people += "'seat_number', '', 'save', false)) AS passengers"
    accepted = spark.createDataFrame([(1, 1500), (2, 10)], "request_id long, n int").selectExpr(
        "request_id", "TIMESTAMP_NTZ'2001-07-01 00:00:00' AS request_ts", "7L AS user_id", people
    )
    new = admission.new_passenger_rows(accepted, 10**6)
    assert new.select("passenger_id").distinct().count() == new.count() == 1510
    links = admission.link_rows(accepted, 1000, 10**6, 10**7)
    assert links.select("booking_passenger_id").distinct().count() == 1510
    assert links.join(new, "passenger_id").count() == 1510
