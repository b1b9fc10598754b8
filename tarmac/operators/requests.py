"""Request tables for new users, passengers, aircraft and flights.

A null field is a field not given. All field checks report together; uniqueness is checked only for requests that pass
them, and the earliest valid request wins within a batch.
"""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import rules
from tarmac.functions.expr import PRICE, blank, lenient_int
from tarmac.functions.rules import emptied, failures, first_failure, given_rules, text
from tarmac.plans.combine import asked_for
from tarmac.plans.lookup import lookup
from tarmac.plans.outcome import Outcome, reject_taken


def register_users(
    requests: DataFrame, users: DataFrame, as_of: date | str, collation: str | None = None
) -> Outcome:
    """New users with an e-mail that is unique, by ``collation`` if given. The password is checked and dropped."""
    given = {c: F.col(c).isNotNull() for c in ("phone", "dob", "address")}
    reasons = failures(
        *rules.name_rules("first_name", F.col("first_name")),
        *rules.name_rules("last_name", F.col("last_name")),
        *rules.email_rules(F.col("email")),
        *rules.password_rules(F.col("password"), F.col("confirm_password")),
        *rules.phone_rules(F.col("phone"), given["phone"]),
        *rules.birth_rules(F.col("dob"), given["dob"], as_of),
        rules.length_rule("address", F.col("address"), rules.ADDRESS_LENGTH),
    )
    checked = requests.select(
        "request_id",
        text(F.col("first_name")).alias("first_name"),
        text(F.col("last_name")).alias("last_name"),
        rules.normal_email(F.col("email")).alias("email"),
        emptied(rules.trimmed(F.col("phone"))).alias("phone"),
        rules.parsed_date(F.col("dob")).alias("date_of_birth"),
        emptied(rules.trimmed(F.col("address"))).alias("address"),
        F.lit("user").alias("role"),
        F.lit("active").alias("status"),
        reasons.alias("reasons"),
    )
    decided = reject_taken(checked, "email", users, "email_taken", collation=collation)
    return Outcome(
        decided,
        "request_id",
        ["first_name", "last_name", "email", "phone", "date_of_birth", "address", "role", "status"],
    )


def add_passengers(requests: DataFrame, as_of: date | str) -> Outcome:
    """Saved passengers of a user."""
    reasons = failures(
        *rules.name_rules("first_name", F.col("first_name")),
        *rules.name_rules("last_name", F.col("last_name")),
        *rules.birth_rules(F.col("date_of_birth"), F.col("date_of_birth").isNotNull(), as_of),
        rules.length_rule("passport_number", F.col("passport_number"), rules.PASSPORT_LENGTH),
        rules.length_rule("nationality", F.col("nationality"), rules.NATIONALITY_LENGTH),
    )
    decided = requests.select(
        "request_id",
        "user_id",
        text(F.col("first_name")).alias("first_name"),
        text(F.col("last_name")).alias("last_name"),
        rules.parsed_date(F.col("date_of_birth")).alias("date_of_birth"),
        emptied(rules.trimmed(F.col("passport_number"))).alias("passport_number"),
        emptied(rules.trimmed(F.col("nationality"))).alias("nationality"),
        F.lit(1).alias("is_saved"),
        reasons.alias("reasons"),
    )
    return Outcome(
        decided,
        "request_id",
        ["user_id", "first_name", "last_name", "date_of_birth", "passport_number", "nationality", "is_saved"],
    )


def create_aircraft(requests: DataFrame, aircraft: DataFrame) -> Outcome:
    """New aircraft with a unique registration."""
    reasons = failures(
        *rules.model_rules(F.col("model")),
        *rules.registration_rules(F.col("registration")),
        rules.capacity_rule(F.col("capacity")),
        *given_rules(
            F.col("status").isNotNull(), [rules.domain_rule("status", F.col("status"), rules.AIRCRAFT_STATUS)]
        ),
    )
    checked = requests.select(
        "request_id",
        text(F.col("model")).alias("model"),
        F.upper(text(F.col("registration"))).alias("registration"),
        rules.whole_number(F.col("capacity")).try_cast("int").alias("capacity"),
        F.coalesce("status", F.lit("active")).alias("status"),
        reasons.alias("reasons"),
    )
    decided = reject_taken(checked, "registration", aircraft, "registration_taken")
    return Outcome(decided, "request_id", ["model", "registration", "capacity", "status"])


def create_flights(requests: DataFrame, flights: DataFrame) -> Outcome:
    """New flights with a unique number; a business or first class price of 0, empty or null is derived from the base price.

    The first failing check wins: required fields, number, readable dates and price, order of the dates. A number is
    taken if the base table has it or an earlier request got it, and that is tested before the dates.
    """
    base = F.col("base_price").try_cast(PRICE)
    required = ("flight_number", "from_airport_code", "to_airport_code", "departure_datetime", "arrival_datetime")
    missing = F.col("base_price").isNull() | blank(F.col("aircraft_id"))
    for name in required:
        missing = missing | blank(F.col(name))
    departure = F.col("departure_datetime").try_cast("timestamp_ntz")
    arrival = F.col("arrival_datetime").try_cast("timestamp_ntz")

    def price(name: str, factor: str):
        given = F.col(name).try_cast(PRICE)
        derived = (base.cast("decimal(20,2)") * F.lit(factor).cast("decimal(2,1)")).try_cast(PRICE)
        return F.when(blank(F.col(name)) | (given == 0), derived).otherwise(given)

    business, first_class = price("business_price", "1.5"), price("first_class_price", "2.0")

    checked = requests.select(
        "request_id",
        "flight_number",
        lenient_int(F.col("aircraft_id")).alias("aircraft_id"),
        "from_airport_code",
        "to_airport_code",
        departure.alias("departure_datetime"),
        arrival.alias("arrival_datetime"),
        base.alias("base_price"),
        business.alias("business_price"),
        first_class.alias("first_class_price"),
        F.coalesce("status", F.lit("scheduled")).alias("status"),
        F.when(missing, F.array(F.lit("missing_fields"))).otherwise(F.array().cast("array<string>")).alias("missing"),
        first_failure(
            (departure.isNull() | arrival.isNull(), "invalid_date"),
            (arrival <= departure, "arrival_not_after_departure"),
            (base.isNull() | lenient_int(F.col("aircraft_id")).isNull(), "invalid_number"),
            # Given but unreadable, or too large, be it given or derived.
            (business.isNull() | first_class.isNull(), "invalid_number"),
        ).alias("late"),
    )
    complete = F.size("missing") == 0
    first = (
        checked.where(complete & (F.size("late") == 0))
        .groupBy("flight_number")
        .agg(F.min("request_id").alias("first_id"))
    )
    holders = (
        asked_for(flights, checked, "flight_number").select("flight_number", F.lit(None).cast("long").alias("first_id"), F.lit(True).alias("in_base"))
        .unionByName(first.withColumn("in_base", F.lit(False)))
        .groupBy("flight_number")
        .agg(F.min("first_id").alias("first_id"), F.bool_or("in_base").alias("in_base"))
    )
    taken = F.coalesce(F.col("in_base") | (F.col("first_id") < F.col("request_id")), F.lit(False))
    decided = lookup(checked, holders, ["flight_number"], "request_id").withColumn(
        "reasons",
        F.when(~complete, F.col("missing"))
        .when(taken, F.array(F.lit("flight_number_taken")))
        .otherwise(F.col("late")),
    )
    return Outcome(
        decided,
        "request_id",
        [
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
        ],
    )
