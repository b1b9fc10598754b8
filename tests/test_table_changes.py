"""Change feeds on users, aircraft and flights, and guarded deletes."""

from decimal import Decimal

from rows import frame, reasons, table, ts
from tarmac.operators import table_changes as feeds

AS_OF = "2001-07-15"


def updates(spark, entity, *rows):
    """Rows (id, entity id, changes), one minute apart."""
    ddl = f"change_id BIGINT, change_ts TIMESTAMP_NTZ, {entity} BIGINT, changes MAP<STRING, STRING>"
    return frame(
        spark,
        ddl,
        [{"change_id": i, "change_ts": f"2001-07-01 10:{i:02d}:00", entity: e, "changes": c} for i, e, c in rows],
    )


def test_user_status(spark):
    users = table(
        spark,
        "users",
        {"user_id": 1, "role": "admin", "status": "active"},
        {"user_id": 2, "role": "admin", "status": "inactive"},
        {"user_id": 3, "role": "user", "status": "active"},
        {"user_id": 4, "role": "user", "status": "active"},
    )
    ddl = "change_id BIGINT, change_ts TIMESTAMP_NTZ, admin_id BIGINT, user_id BIGINT, status STRING"
    rows = [
        (1, 1, 3, "suspended"),
        (2, 1, 3, "inactive"),
        (3, 1, 3, "gone"),
        (4, 1, 1, "inactive"),
        (5, 1, 1, "active"),
        (6, 1, 2, "suspended"),
        (7, 1, 2, "active"),
        (8, 1, 9, "active"),
        (9, 9, 9, "inactive"),
        (10, 1, 3, None),
    ]
    feed = frame(
        spark,
        ddl,
        [
            {"change_id": i, "change_ts": f"2001-07-01 10:{i:02d}:00", "admin_id": a, "user_id": u, "status": s}
            for i, a, u, s in rows
        ],
    )
    outcome = feeds.user_status_changes(users, feed)
    assert reasons(outcome.decided, "change_id") == {
        1: [],
        2: [],
        3: ["status_unknown"],
        4: ["own_status"],
        5: [],
        6: ["admin_status"],
        7: [],
        8: ["user_not_found"],
        9: ["own_status"],
        10: ["status_unknown"],
    }
    after = {r.user_id: r for r in feeds.apply_user_status(users, outcome.accepted).collect()}
    assert {i: r.status for i, r in after.items()} == {1: "active", 2: "active", 3: "inactive", 4: "active"}
    assert after[3].updated_at == ts("2001-07-01 10:02:00") and after[4].updated_at is None


def test_profiles(spark):
    users = table(
        spark,
        "users",
        {"user_id": 1, "first_name": "A", "email": "one@x.yz", "phone": "1", "address": "Here"},
        {"user_id": 2, "first_name": "B", "email": "two@x.yz", "phone": "2", "address": "There"},
        {"user_id": 3, "first_name": "C", "email": "three@x.yz"},
    )
    feed = updates(
        spark,
        "user_id",
        (1, 1, {"firstName": " Ann ", "address": ""}),
        (2, 1, {"firstName": ""}),
        (3, 1, {"phone": None}),
        (4, 1, {}),
        (5, 1, None),
        (6, 1, {"colour": "red"}),
        (7, 2, {"email": "One@x.yz"}),
        (8, 2, {"email": "TWO@x.yz"}),
        (9, 1, {"email": "new@x.yz"}),
        (10, 2, {"email": "new@x.yz"}),
        (11, 1, {"email": "new@x.yz", "address": None}),
        (12, 3, {"email": "one@x.yz"}),
        (13, 9, {"firstName": "Bob"}),
        (14, 3, {"dateOfBirth": "1850-01-01", "email": "bad"}),
        (15, 3, {"dateOfBirth": "1990-02-03", "lastName": "Lee", "phone": "+1 (2)"}),
        (16, 3, {"address": "x" * 501}),
    )
    outcome = feeds.profile_updates(users, feed, AS_OF)
    assert reasons(outcome.decided, "change_id") == {
        1: [],
        2: ["first_name_required", "first_name_length", "first_name_characters"],
        3: ["phone_format"],
        4: ["no_fields"],
        5: ["no_fields"],
        6: ["no_fields"],
        7: ["email_taken"],
        8: [],
        9: [],
        10: ["email_taken"],
        11: [],
        12: ["email_taken"],
        13: ["user_not_found"],
        14: ["email_format", "date_of_birth_range"],
        15: [],
        16: ["address_length"],
    }
    after = {r.user_id: r for r in feeds.apply_profiles(users, outcome.accepted).collect()}
    assert (after[1].first_name, after[1].email, after[1].address, after[1].phone) == ("Ann", "new@x.yz", None, "1")
    assert (after[2].first_name, after[2].email, after[2].address) == ("B", "two@x.yz", "There")
    assert (after[3].last_name, str(after[3].date_of_birth), after[3].phone) == ("Lee", "1990-02-03", "+1 (2)")
    assert after[1].updated_at == ts("2001-07-01 10:11:00")


def test_earlier_claim_must_itself_be_accepted(spark):
    """The base holder keeps its value although another one asked first; an invalid claim claims nothing."""
    flights = table(
        spark, "flights", {"flight_id": 1, "flight_number": "A"}, {"flight_id": 2, "flight_number": "B"}, {"flight_id": 3}
    )
    late = {"departure_datetime": "2001-07-02 10:00:00", "arrival_datetime": "2001-07-02 10:00:00"}
    feed = updates(
        spark,
        "flight_id",
        (1, 2, {"flight_number": "A"}),
        (2, 1, {"flight_number": "A"}),
        (3, 2, {"flight_number": "C", **late}),
        (4, 3, {"flight_number": "C"}),
        (5, 1, {"flight_number": "C", **late}),
        (6, 3, {"flight_number": "C", **late}),
    )
    outcome = feeds.flight_updates(flights, feed)
    assert reasons(outcome.decided, "change_id") == {
        1: ["flight_number_taken"],
        2: [],
        3: ["arrival_not_after_departure"],
        4: [],
        5: ["flight_number_taken"],
        6: ["arrival_not_after_departure"],
    }


def test_aircraft(spark):
    aircraft = table(
        spark,
        "aircraft",
        {"aircraft_id": 1, "model": "A", "registration": "R-1", "capacity": 10, "status": "active"},
        {"aircraft_id": 2, "model": "B", "registration": "R-2", "capacity": 20, "status": "active"},
    )
    feed = updates(
        spark,
        "aircraft_id",
        (1, 1, {"model": "", "registration": ""}),
        (2, 1, {"capacity": "0"}),
        (3, 1, {"capacity": None}),
        (4, 1, {"status": "broken"}),
        (5, 9, {"status": "retired"}),
        (6, 1, {"registration": "R-2"}),
        (7, 1, {}),
        (8, 1, {"registration": " R-3 ", "capacity": "+300"}),
        (9, 2, {"registration": "R-1", "status": "retired"}),
        (10, 2, {"model": "BB"}),
        (11, 9, {}),
    )
    outcome = feeds.aircraft_updates(aircraft, feed)
    assert reasons(outcome.decided, "change_id") == {
        1: ["model_required", "registration_required", "registration_characters"],
        2: ["capacity_range"],
        3: ["capacity_range"],
        4: ["status_unknown"],
        5: ["aircraft_not_found"],
        6: ["registration_taken"],
        7: ["no_fields"],
        8: [],
        9: ["registration_taken"],
        10: [],
        11: ["aircraft_not_found"],
    }
    after = {r.aircraft_id: r for r in feeds.apply_aircraft(aircraft, outcome.accepted).collect()}
    assert (after[1].registration, after[1].capacity, after[1].model) == ("R-3", 300, "A")
    assert (after[2].registration, after[2].model, after[2].status) == ("R-2", "BB", "active")


def test_flights(spark):
    flights = table(
        spark,
        "flights",
        {"flight_id": 1, "flight_number": "A", "aircraft_id": 5, "base_price": 10, "business_price": 20, "status": "x"},
    )
    feed = updates(
        spark,
        "flight_id",
        (1, 1, {"flight_number": "", "aircraft_id": "0", "status": "", "departure_datetime": None}),
        (2, 1, {"base_price": "0", "aircraft_id": "7 wings"}),
        (3, 1, {"departure_datetime": "2001-07-02 10:00:00"}),
        (4, 1, {"arrival_datetime": "2001-07-02 09:00:00"}),
        (5, 1, {"departure_datetime": "2001-07-02 10:00:00", "arrival_datetime": "2001-07-02 09:00:00"}),
        (6, 1, {"departure_datetime": "soon"}),
        (7, 1, {"base_price": ""}),
        (8, 1, {"business_price": None}),
        (9, 9, {"status": "delayed"}),
        (10, 1, {"status": "delayed"}),
    )
    outcome = feeds.flight_updates(flights, feed)
    assert reasons(outcome.decided, "change_id") == {
        1: ["no_fields"],
        2: [],
        3: [],
        4: [],
        5: ["arrival_not_after_departure"],
        6: ["invalid_value"],
        7: ["invalid_value"],
        8: ["no_fields"],
        9: ["flight_not_found"],
        10: [],
    }
    (after,) = feeds.apply_flights(flights, outcome.accepted).collect()
    assert (after.flight_number, after.aircraft_id, after.status) == ("A", 7, "delayed")
    assert (after.base_price, after.business_price) == (Decimal("0.00"), Decimal("20.00"))
    assert after.arrival_datetime == ts("2001-07-02 09:00:00")


def test_deletes(spark):
    flights = table(spark, "flights", *[{"flight_id": i, "aircraft_id": 1} for i in (1, 2, 3)])
    states = [(1, "cancelled"), (1, "completed"), (2, "pending"), (2, "missed"), (2, "cancelled"), (3, None)]
    bookings = table(spark, "bookings", *[{"booking_id": i, "flight_id": f, "status": s} for i, (f, s) in enumerate(states)])
    requests = frame(
        spark, "request_id BIGINT, flight_id BIGINT", [{"request_id": i, "flight_id": f} for i, f in [(1, 1), (2, 2), (3, 1), (4, 9), (5, 3)]]
    )
    outcome = feeds.delete_flights(requests, flights, bookings)
    assert reasons(outcome.decided) == {1: [], 2: ["active_bookings"], 3: ["flight_not_found"], 4: ["flight_not_found"], 5: []}
    assert {r.request_id: r.uses for r in outcome.decided.collect()} == {1: 0, 2: 2, 3: 0, 4: 0, 5: 0}
    assert [r.flight_id for r in feeds.without(flights, outcome.accepted, "flight_id").collect()] == [2]

    aircraft = table(spark, "aircraft", {"aircraft_id": 1}, {"aircraft_id": 2})
    requests = frame(
        spark, "request_id BIGINT, aircraft_id BIGINT", [{"request_id": i, "aircraft_id": i} for i in (1, 2, 3)]
    )
    outcome = feeds.delete_aircraft(requests, aircraft, flights)
    assert reasons(outcome.decided) == {1: ["used_by_flights"], 2: [], 3: ["aircraft_not_found"]}
