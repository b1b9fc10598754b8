"""Change feeds on users, aircraft and flights, and guarded deletes.

Partial updates come as ``changes``, a map of texts or a VARIANT (a JSON body, by ``try_parse_json``): an absent key
keeps the field, and where the rules let an empty text or null through it clears it. A VARIANT tells the number 0 and
``false`` from texts that read alike. A body that is no object is refused as ``invalid_body``, one that gives an object or
a list for a field as ``nested_value``.
"""

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions import rules
from tarmac.functions.expr import PRICE, lenient_int
from tarmac.functions.rules import emptied, failures, first_failure, given_rules, text
from tarmac.plans.combine import asked_for
from tarmac.plans.lookup import lookup
from tarmac.plans.outcome import Outcome, is_ok
from tarmac.plans.updates import apply_last, with_conflict
from tarmac.sources.work import stored


def user_status_changes(users: DataFrame, changes: DataFrame) -> Outcome:
    """Decide ``changes`` (change_id, change_ts, admin_id, user_id, status); the first failing check is the reason."""
    status = F.col("status")
    off = status != "active"
    roles = users.select("user_id", F.lit(True).alias("known"), "role")
    decided = lookup(changes, roles, ["user_id"], "change_id").withColumn(
        "reasons",
        first_failure(
            rules.domain_rule("status", status, rules.USER_STATUS),
            ((F.col("user_id") == F.col("admin_id")) & off, "own_status"),
            (F.col("known").isNull(), "user_not_found"),
            ((F.col("role") == "admin") & off, "admin_status"),
        ),
    )
    return Outcome(decided, "change_id", ["change_ts", "user_id", "status"])


def apply_user_status(users: DataFrame, accepted: DataFrame) -> DataFrame:
    """The users table after the accepted status changes; the last one counts."""
    return apply_last(users, accepted.withColumn("has_status", F.lit(True)), "user_id", ["status"])


def _opened(changes: DataFrame, base: DataFrame, entity: str, keys: dict[str, str]) -> DataFrame:
    """Changes with their values opened, and whether the row to change exists.

    Of each field: ``has_``, whether it was there; ``raw_``, its text; ``no_``, whether it is empty or 0. ``broken`` says
    why a body cannot be read.
    """
    known = base.select(entity, F.lit(True).alias("known"))
    is_variant = isinstance(changes.schema["changes"].dataType, T.VariantType)
    opened = (_of_variant if is_variant else _of_map)(keys)
    return lookup(changes.select("change_id", "change_ts", entity, *opened), known, [entity], "change_id")


def _of_map(keys: dict[str, str]) -> list[Column]:
    raw = {f: F.col("changes")[k] for f, k in keys.items()}
    return [
        *[F.coalesce(F.map_contains_key("changes", k), F.lit(False)).alias(f"has_{f}") for f, k in keys.items()],
        *[raw[f].alias(f"raw_{f}") for f in keys],
        *[raw[f].isin("", "0").alias(f"no_{f}") for f in keys],
        F.array().cast("array<string>").alias("broken"),
    ]


def _of_variant(keys: dict[str, str]) -> list[Column]:
    body = F.col("changes")
    value = {f: F.try_variant_get(body, f"$.{k}", "variant") for f, k in keys.items()}
    raw = {f: F.try_variant_get(body, f"$.{k}", "string") for f, k in keys.items()}
    kind = {f: F.schema_of_variant(value[f]) for f in keys}
    zero = {f: (kind[f] != "STRING") & ((raw[f] == "false") | (raw[f].try_cast("double") == 0)) for f in keys}
    is_object = F.coalesce(F.schema_of_variant(body).startswith("OBJECT"), F.lit(False))
    nested = _any([F.coalesce(kind[f].rlike("^(OBJECT|ARRAY)"), F.lit(False)) for f in keys])
    return [
        *[value[f].isNotNull().alias(f"has_{f}") for f in keys],
        *[raw[f].alias(f"raw_{f}") for f in keys],
        *[((raw[f] == "") | F.coalesce(zero[f], F.lit(False))).alias(f"no_{f}") for f in keys],
        first_failure((~is_object, "invalid_body"), (nested, "nested_value")).alias("broken"),
    ]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# Profiles

PROFILE_FIELDS = ["first_name", "last_name", "email", "phone", "date_of_birth", "address"]


def profile_updates(
    users: DataFrame, changes: DataFrame, as_of: date | str, collation: str | None = None
) -> Outcome:
    """Decide profile updates (change_id, change_ts, user_id, changes); e-mails stay unique, by ``collation`` if given."""
    keys = dict(zip(PROFILE_FIELDS, ["firstName", "lastName", "email", "phone", "dateOfBirth", "address"], strict=True))
    given, raw = {f: F.col(f"has_{f}") for f in keys}, {f: F.col(f"raw_{f}") for f in keys}
    early = failures(
        *given_rules(given["first_name"], rules.name_rules("first_name", raw["first_name"])),
        *given_rules(given["last_name"], rules.name_rules("last_name", raw["last_name"])),
        *given_rules(given["email"], rules.email_rules(raw["email"])),
        *rules.phone_rules(raw["phone"], given["phone"]),
        *rules.birth_rules(raw["date_of_birth"], given["date_of_birth"], as_of),
        rules.length_rule("address", raw["address"], rules.ADDRESS_LENGTH),
    )
    checked = _opened(changes, users, "user_id", keys).select(
        "change_id",
        "change_ts",
        "user_id",
        "broken",
        *given.values(),
        text(raw["first_name"]).alias("first_name"),
        text(raw["last_name"]).alias("last_name"),
        F.when(given["email"], rules.normal_email(raw["email"])).alias("email"),
        emptied(text(raw["phone"])).alias("phone"),
        rules.parsed_date(raw["date_of_birth"]).alias("date_of_birth"),
        emptied(text(raw["address"])).alias("address"),
        F.when(F.col("known").isNull(), F.array(F.lit("user_not_found"))).otherwise(early).alias("early"),
        first_failure((~_any(list(given.values())), "no_fields")).alias("late"),
    )
    return _decided(checked, users, "user_id", "email", "email_taken", PROFILE_FIELDS, collation)


def apply_profiles(users: DataFrame, accepted: DataFrame) -> DataFrame:
    return apply_last(users, accepted, "user_id", PROFILE_FIELDS)


# Aircraft

AIRCRAFT_FIELDS = ["model", "registration", "capacity", "status"]


def aircraft_updates(aircraft: DataFrame, changes: DataFrame) -> Outcome:
    """Decide aircraft updates (change_id, change_ts, aircraft_id, changes); registrations stay unique."""
    keys = {f: f for f in AIRCRAFT_FIELDS}
    given, raw = {f: F.col(f"has_{f}") for f in keys}, {f: F.col(f"raw_{f}") for f in keys}
    invalid = failures(
        *given_rules(given["model"], rules.model_rules(raw["model"])),
        *given_rules(given["registration"], rules.registration_rules(raw["registration"])),
        *given_rules(given["capacity"], [rules.capacity_rule(raw["capacity"])]),
        *given_rules(given["status"], [rules.domain_rule("status", raw["status"], rules.AIRCRAFT_STATUS)]),
    )
    unknown = first_failure((F.col("known").isNull(), "aircraft_not_found"))
    checked = _opened(changes, aircraft, "aircraft_id", keys).select(
        "change_id",
        "change_ts",
        "aircraft_id",
        "broken",
        *given.values(),
        text(raw["model"]).alias("model"),
        F.when(given["registration"], F.upper(text(raw["registration"]))).alias("registration"),
        rules.whole_number(raw["capacity"]).try_cast("int").alias("capacity"),
        raw["status"].alias("status"),
        F.when(F.size(invalid) > 0, invalid).otherwise(unknown).alias("early"),
        first_failure((~_any(list(given.values())), "no_fields")).alias("late"),
    )
    return _decided(checked, aircraft, "aircraft_id", "registration", "registration_taken", AIRCRAFT_FIELDS)


def apply_aircraft(aircraft: DataFrame, accepted: DataFrame) -> DataFrame:
    return apply_last(aircraft, accepted, "aircraft_id", AIRCRAFT_FIELDS)


# Flights

FLIGHT_FIELDS = [
    "flight_number",
    "aircraft_id",
    "from_airport_code",
    "to_airport_code",
    "departure_datetime",
    "arrival_datetime",
    "status",
    "base_price",
    "business_price",
    "first_class_price",
]
PRICE_FIELDS = FLIGHT_FIELDS[7:]


def flight_updates(flights: DataFrame, changes: DataFrame) -> Outcome:
    """Decide flight updates (change_id, change_ts, flight_id, changes); flight numbers stay unique.

    An empty text or 0 (in a VARIANT, the number) is no value, except for prices, where 0 is kept. The order of the dates is tested only if both
    are given.
    """
    raw = {f: F.col(f"raw_{f}") for f in FLIGHT_FIELDS}
    value = {f: F.when(~F.col(f"no_{f}"), raw[f]) for f in FLIGHT_FIELDS if f not in PRICE_FIELDS}
    given = {f: value.get(f, raw[f]).isNotNull().alias(f"has_{f}") for f in FLIGHT_FIELDS}
    value["aircraft_id"] = lenient_int(value["aircraft_id"])
    for name in ("departure_datetime", "arrival_datetime"):
        value[name] = value[name].try_cast("timestamp_ntz")
    for name in PRICE_FIELDS:
        value[name] = raw[name].try_cast(PRICE)
    opened = _opened(changes, flights, "flight_id", {f: f for f in FLIGHT_FIELDS}).select(
        *("change_id", "change_ts", "flight_id", "known", "broken"),
        *given.values(),
        *[value[f].alias(f) for f in FLIGHT_FIELDS],
    )
    has = {f: F.col(f"has_{f}") for f in FLIGHT_FIELDS}
    backwards = F.col("arrival_datetime") <= F.col("departure_datetime")
    checked = opened.withColumns(
        {
            "early": first_failure((F.col("known").isNull(), "flight_not_found")),
            "late": first_failure(
                (~_any(list(has.values())), "no_fields"),
                (has["departure_datetime"] & has["arrival_datetime"] & backwards, "arrival_not_after_departure"),
                (_any([has[f] & F.col(f).isNull() for f in FLIGHT_FIELDS]), "invalid_value"),
            ),
        }
    )
    return _decided(checked, flights, "flight_id", "flight_number", "flight_number_taken", FLIGHT_FIELDS)


def apply_flights(flights: DataFrame, accepted: DataFrame) -> DataFrame:
    return apply_last(flights, accepted, "flight_id", FLIGHT_FIELDS)


def _decided(
    checked: DataFrame,
    base: DataFrame,
    entity: str,
    unique: str,
    reason: str,
    fields: list[str],
    collation: str | None = None,
) -> Outcome:
    """Reasons in order: ``broken``, ``early``, a conflict on the ``unique`` field, ``late``.

    The checked changes are stored first; the claims, their holders and the decisions all read them.
    """
    checked = stored(checked, "checked-updates")
    valid = (F.size("broken") == 0) & (F.size("early") == 0) & (F.size("late") == 0)
    decided = with_conflict(checked, valid, base, entity, unique, collation).withColumn(
        "reasons",
        F.when(F.size("broken") > 0, F.col("broken"))
        .when(F.size("early") > 0, F.col("early"))
        .when(F.col("conflict"), F.array(F.lit(reason)))
        .otherwise(F.col("late")),
    )
    return Outcome(decided, "change_id", ["change_ts", entity, *[f"has_{f}" for f in fields], *fields])


# Deletes


def _delete(requests: DataFrame, base: DataFrame, uses: DataFrame, entity: str, missing: str, blocked: str) -> Outcome:
    """Delete rows of ``base`` that ``uses`` does not count; only the first request for a row finds it."""
    known = base.select(entity, F.lit(True).alias("known")).join(uses, entity, "left")
    checked = (
        lookup(requests, known, [entity], "request_id")
        .withColumn("uses", F.coalesce("uses", F.lit(0)))
        .withColumn("reasons", first_failure((F.col("known").isNull(), missing), (F.col("uses") > 0, blocked)))
    )
    first = checked.where(is_ok()).groupBy(entity).agg(F.min("request_id").alias("request_id"))
    again = is_ok() & F.col("first").isNull()
    decided = (
        checked.join(first.select("request_id", F.lit(True).alias("first")), "request_id", "left")
        .withColumn("reasons", F.when(again, F.array(F.lit(missing))).otherwise(F.col("reasons")))
        .withColumn("uses", F.when(again, F.lit(0)).otherwise(F.col("uses")))
    )
    return Outcome(decided, "request_id", [entity])


def delete_flights(requests: DataFrame, flights: DataFrame, bookings: DataFrame) -> Outcome:
    """Decide deletes (request_id, flight_id); a flight with bookings neither cancelled nor completed stays.

    ``uses`` of the decided rows is the number of those bookings.
    """
    live = bookings.where(~F.col("status").isin("cancelled", "completed"))
    uses = asked_for(live, requests, "flight_id").groupBy("flight_id").agg(F.count("*").alias("uses"))
    return _delete(requests, flights, uses, "flight_id", "flight_not_found", "active_bookings")


def delete_aircraft(requests: DataFrame, aircraft: DataFrame, flights: DataFrame) -> Outcome:
    """Decide deletes (request_id, aircraft_id); an aircraft any flight uses stays."""
    uses = asked_for(flights, requests, "aircraft_id").groupBy("aircraft_id").agg(F.count("*").alias("uses"))
    return _delete(requests, aircraft, uses, "aircraft_id", "aircraft_not_found", "used_by_flights")


def without(base: DataFrame, accepted: DataFrame, entity: str) -> DataFrame:
    """``base`` after the accepted deletes."""
    return base.join(accepted.select(entity), entity, "left_anti")
