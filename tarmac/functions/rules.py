"""Field checks of request tables. A rule pairs the condition of a failure with its code."""

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.functions.expr import day

# Patterns, lengths and domains of the request fields.
NAME = r"^[a-zA-Z\s'-]+$"
NAME_LENGTH = (2, 100)
EMAIL = (
    r"^[a-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*"
    r"@([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}$"
)
EMAIL_LENGTH, EMAIL_LOCAL_LENGTH = 255, 64
PASSWORD = r"^(?=.*[a-z])(?=.*[A-Z])(?=.*\d)"
PASSWORD_LENGTH = 6
PHONE = r"^[\d\s\-+()]+$"
PHONE_LENGTH = 20
ADDRESS_LENGTH = 500
MAX_AGE = 120
PASSPORT_LENGTH, NATIONALITY_LENGTH = 50, 100
MODEL_LENGTH = 100
REGISTRATION = r"^[A-Z0-9-]+$"
REGISTRATION_LENGTH = 20
CAPACITY = (1, 1000)
AIRCRAFT_STATUS = ("active", "maintenance", "retired")
USER_STATUS = ("active", "inactive", "suspended")
BOOKING_REFERENCE = r"^[A-Z0-9]+$"
BOOKING_REFERENCE_LENGTH = (5, 20)
GATE_LENGTH = 10
WHITESPACE = " \t\n\r\f\v"

Rule = tuple[Column, str]


def failures(*rules: Rule) -> Column:
    """Codes of all rules that fail, in order."""
    return F.array_compact(F.array(*[F.when(failed, F.lit(code)) for failed, code in rules]))


def first_failure(*rules: Rule) -> Column:
    """The code of the first rule that fails, as an array of at most one."""
    return F.slice(failures(*rules), 1, 1)


def trimmed(value: Column) -> Column:
    return F.trim(value, F.lit(WHITESPACE))


def text(value: Column) -> Column:
    """A trimmed text, empty where there is none."""
    return F.coalesce(trimmed(value), F.lit(""))


def emptied(value: Column) -> Column:
    """A text with null for empty."""
    return F.when(value != "", value)


def normal_email(value: Column) -> Column:
    return F.lower(text(value))


def parsed_date(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), value.try_cast("date"))


def name_rules(field: str, value: Column) -> list[Rule]:
    value = text(value)
    low, high = NAME_LENGTH
    return [
        (value == "", f"{field}_required"),
        (~F.length(value).between(low, high), f"{field}_length"),
        (~value.rlike(NAME), f"{field}_characters"),
    ]


def email_rules(value: Column) -> list[Rule]:
    value = normal_email(value)
    long_local = F.length(F.substring_index(value, "@", 1)) > EMAIL_LOCAL_LENGTH
    return [
        (~value.rlike(EMAIL) | long_local, "email_format"),
        (F.length(value) > EMAIL_LENGTH, "email_length"),
    ]


def password_rules(password: Column, confirmation: Column) -> list[Rule]:
    value = F.coalesce(password, F.lit(""))
    return [
        (F.length(value) < PASSWORD_LENGTH, "password_length"),
        (~value.rlike(PASSWORD), "password_strength"),
        (~password.eqNullSafe(confirmation), "password_confirmation"),
    ]


def phone_rules(value: Column, given: Column) -> list[Rule]:
    value = text(value)
    return [
        (given & ~value.rlike(PHONE), "phone_format"),
        (given & (F.length(value) > PHONE_LENGTH), "phone_length"),
    ]


def birth_rules(value: Column, given: Column, as_of: date | str) -> list[Rule]:
    """The age test compares years only."""
    born = parsed_date(value)
    return [
        (given & born.isNull(), "date_of_birth_format"),
        (given & ~(F.year(day(as_of)) - F.year(born)).between(0, MAX_AGE), "date_of_birth_range"),
    ]


def length_rule(field: str, value: Column, limit: int) -> Rule:
    return F.length(text(value)) > limit, f"{field}_length"


def model_rules(value: Column) -> list[Rule]:
    return [(text(value) == "", "model_required"), length_rule("model", value, MODEL_LENGTH)]


def registration_rules(value: Column) -> list[Rule]:
    return [
        (text(value) == "", "registration_required"),
        length_rule("registration", value, REGISTRATION_LENGTH),
        (~text(value).rlike(REGISTRATION), "registration_characters"),
    ]


def whole_number(value: Column) -> Column:
    """A text that is nothing but an integer, as a number."""
    return F.when(value.rlike(r"^[-+]?[0-9]+$"), value.try_cast("bigint"))


def capacity_rule(value: Column) -> Rule:
    low, high = CAPACITY
    return ~F.coalesce(whole_number(value).between(low, high), F.lit(False)), "capacity_range"


def domain_rule(field: str, value: Column, allowed: tuple[str, ...]) -> Rule:
    return ~F.coalesce(value.isin(*allowed), F.lit(False)), f"{field}_unknown"


def given_rules(given: Column, rules: list[Rule]) -> list[Rule]:
    """Rules that only count where the field is given."""
    return [(given & failed, code) for failed, code in rules]
