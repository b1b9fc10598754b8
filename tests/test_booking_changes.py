"""Booking changes against a plain loop, in batch and as a stream."""

import random
from datetime import datetime, timedelta

import pytest

from rows import frame, reasons, table, ts
from tarmac.operators.booking_changes import apply_changes, decide_changes
from tarmac.plans.carried import carried
from tarmac.streaming.booking_changes import change_available

CHANGE = (
    "change_id BIGINT, change_ts TIMESTAMP_NTZ, booking_id BIGINT, requester_id BIGINT, op STRING, status STRING, "
    "payment_status STRING"
)
COLUMNS = [c.split(" ")[0] for c in CHANGE.split(", ")]
STATES = ["pending", "confirmed", "cancelled", "completed", "missed", None]


def make(seed, bookings=8, count=800, hot=0.4):
    rng = random.Random(seed)
    state = {b: (STATES[b % len(STATES)], "pending") for b in range(bookings)}
    changes = []
    for i in range(count):
        b = 0 if rng.random() < hot else rng.randrange(bookings + 1)
        at = datetime(2001, 7, 1) + timedelta(seconds=rng.randrange(0, 4000))
        op = rng.choice(["cancel", "cancel", "user_status", "admin_status"])
        status = rng.choice(["pending", "confirmed", "cancelled", "completed", "missed", "bogus", None])
        payment = rng.choice([None, None, "paid", "refunded", "bogus"])
        changes.append((i, at, b, b if rng.random() < 0.8 else -1, op, status, payment))
    rng.shuffle(changes)
    return state, changes


def in_order(state, changes):
    """Reasons per change; ``state`` is left as the changes leave it."""
    got = {}
    for i, _, b, who, op, status, payment in sorted(changes, key=lambda c: (c[1], c[0])):
        why = []
        if op == "user_status" and status not in ("completed", "missed", "cancelled"):
            why.append("invalid_status")
        if op == "admin_status" and status not in ("pending", "confirmed", "cancelled", "completed"):
            why.append("invalid_status")
        if op == "admin_status" and payment not in (None, "pending", "paid", "refunded"):
            why.append("invalid_payment_status")
        if not why and (b not in state or (op != "admin_status" and who != b)):
            why.append("booking_not_found")
        if not why and op == "cancel" and state[b][0] in ("cancelled", "completed"):
            why.append(f"already_{state[b][0]}")
        if not why:
            if op == "cancel":
                state[b] = ("cancelled", "refunded")
            else:
                state[b] = (status, payment if op == "admin_status" and payment else state[b][1])
        got[i] = why
    return got


def base(spark, state):
    rows = [{"booking_id": b, "user_id": b, "status": s, "payment_status": p} for b, (s, p) in state.items()]
    return table(spark, "bookings", *rows)


def feed(spark, changes):
    return frame(spark, CHANGE, [dict(zip(COLUMNS, c, strict=True)) for c in changes])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_one_after_the_other(spark, seed):
    state, changes = make(seed)
    bookings = base(spark, state)
    outcome = decide_changes(bookings, feed(spark, changes).repartition(5))
    expected = in_order(state, changes)
    assert reasons(outcome.decided, "change_id") == expected
    after = apply_changes(bookings, outcome.accepted).collect()
    assert {r.booking_id: (r.status, r.payment_status) for r in after} == state
    last = {}
    for c in changes:
        if not expected[c[0]]:
            last[c[2]] = max(last.get(c[2], c[1]), c[1])
    assert {r.booking_id: r.updated_at for r in after if r.updated_at} == last


def test_one_booking_at_one_instant(spark):
    """All changes of one booking at one instant, over many ranges."""
    at = ts("2001-07-01 10:00:00")
    state, changes = make(7, bookings=1, count=3000, hot=1.0)
    changes = [(c[0], at, *c[2:]) for c in changes]
    outcome = decide_changes(base(spark, state), feed(spark, changes))
    assert reasons(outcome.decided, "change_id") == in_order(state, changes)


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_carried_values(spark, share):
    rng = random.Random(6)
    rows = []
    for i in range(2000):
        key = None if rng.random() < 0.1 else 1 if rng.random() < share else rng.randrange(60)
        rows.append((key, i, rng.choice([None, None, None, rng.randrange(9)]), rng.choice([None, "a", "b"])))
    last, expected = {}, {}
    for key, i, a, b in rows:
        old = last.get(key, (None, None))
        expected[i] = old
        last[key] = (old[0] if a is None else a, old[1] if b is None else b)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key long, at long, a int, b string")
    got = carried(df, "key", ["at"], {"last_a": "a", "last_b": "b"})
    assert got.columns == ["key", "at", "a", "b", "last_a", "last_b"]
    assert {r["at"]: (r.last_a, r.last_b) for r in got.collect()} == expected


def test_order_within_one_instant_is_the_id(spark):
    at = ts("2001-07-01 10:00:00")
    changes = [
        (3, at, 1, 1, "cancel", None, None),
        (1, at, 1, 1, "cancel", None, None),
        (2, at, 1, 1, "admin_status", "confirmed", "paid"),
        (4, at, 1, 1, "cancel", None, None),
    ]
    outcome = decide_changes(base(spark, {1: ("confirmed", "paid")}), feed(spark, changes))
    assert reasons(outcome.decided, "change_id") == {1: [], 2: [], 3: [], 4: ["already_cancelled"]}


def test_no_changes_leave_the_table_as_it_is(spark):
    bookings = base(spark, {1: ("confirmed", "paid")})
    outcome = decide_changes(bookings, feed(spark, []))
    assert apply_changes(bookings, outcome.accepted).collect() == bookings.collect()


def test_unknown_op(spark):
    change = (1, ts("2001-07-01 10:00:00"), 1, 1, "erase", None, None)
    outcome = decide_changes(base(spark, {1: ("confirmed", "paid")}), feed(spark, [change]))
    assert reasons(outcome.decided, "change_id") == {1: ["unknown_op"]}


def test_stream_carries_the_state(spark, tmp_path):
    state, changes = make(4, count=600)
    bookings, source, expected = base(spark, state), tmp_path / "changes", {}
    schema = feed(spark, []).schema
    for arrival in range(3):
        part = changes[arrival::3]
        feed(spark, part).repartition(3).write.mode("append").parquet(str(source))
        expected |= in_order(state, part)
        stream = spark.readStream.schema(schema).parquet(str(source))
        decided = change_available(stream, bookings, str(tmp_path / "out"))
    assert {r.change_id: r.reason for r in decided.collect()} == {i: "; ".join(w) for i, w in expected.items()}
