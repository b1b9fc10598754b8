"""Column expressions shared by the operators. Every clock is a parameter; nothing reads the current time."""

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status sets and the money type of a sum.
PAID_STATUS, PAID_PAYMENT = "confirmed", "paid"
OPEN_FLIGHT = ("scheduled", "boarding")
ON_TIME_FLIGHT = ("scheduled", "boarding", "completed")
MONEY_SUM = "decimal(38,2)"
PRICE = "decimal(10,2)"


def day(as_of: date | str) -> Column:
    return F.lit(str(as_of)[:10]).cast("date")


def instant(now: datetime | str) -> Column:
    return F.lit(str(now)).cast("timestamp_ntz")


def midnight(d: Column) -> Column:
    return d.cast("timestamp_ntz")


def in_month(ts: Column, as_of: date | str, back: int = 0) -> Column:
    """``ts`` lies in the calendar month ``back`` months before ``as_of``; a range, so it reaches the scan."""
    start = F.add_months(F.trunc(day(as_of), "MM"), -back)
    return (ts >= midnight(start)) & (ts < midnight(F.add_months(start, 1)))


def since_months(ts: Column, as_of: date | str, months: int) -> Column:
    return ts >= midnight(F.add_months(day(as_of), -months))


def is_paid() -> Column:
    return (F.col("status") == PAID_STATUS) & (F.col("payment_status") == PAID_PAYMENT)


def money(x: Column) -> Column:
    """A sum of money, 0 for no rows."""
    return F.coalesce(F.sum(x), F.lit(0)).cast(MONEY_SUM)


def pct_round(part: Column, whole: Column) -> Column:
    """Whole per cent, halves up; 0 where ``whole`` is 0 or null."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.coalesce(F.floor(ratio * 100 + 0.5), F.lit(0)).cast("long")


def growth_pct(current: Column, previous: Column) -> Column:
    """Change in per cent to one decimal; 0.0 unless ``previous`` is positive."""
    current, previous = current.cast("double"), previous.cast("double")
    change = F.try_divide(current - previous, previous) * 100
    return F.when(previous > 0, F.round(change, 1)).otherwise(F.lit(0.0))


def class_price(flight_class: Column) -> Column:
    """List price of a booking class; an unknown class pays the base price."""
    return (
        F.when(flight_class == "business", F.col("business_price"))
        .when(flight_class == "first", F.col("first_class_price"))
        .otherwise(F.col("base_price"))
    )


def lenient_int(text: Column, sql_type: str = "bigint") -> Column:
    """Leading integer of a text (``'12abc'`` is 12), null if there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast(sql_type)


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def route_name(from_city: Column, to_city: Column) -> Column:
    return F.concat(from_city, F.lit(" → "), to_city)


def hours_and_minutes(minutes: Column) -> Column:
    """``'2h 5m'``; the minute part is rounded on its own and may read 60."""
    minutes = F.coalesce(minutes, F.lit(0.0))
    hours = F.floor(minutes / 60).cast("long")
    rest = F.floor(minutes % 60 + 0.5).cast("long")
    return F.concat(hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m"))


# A request id has at most twice as many bits; nine base-36 digits hold them, and the whole 20 characters.
HALF_BITS = 23
ROUND_KEYS = (1_640_531_527, 1_013_904_223, 1_274_126_177, 974_711_941)


def scrambled(number: Column) -> Column:
    """A bijection of the numbers below 2^(2 * ``HALF_BITS``): Feistel rounds of a keyed product's middle bits."""
    mask = (1 << HALF_BITS) - 1
    left, right = F.shiftright(number, HALF_BITS).bitwiseAND(F.lit(mask)), number.bitwiseAND(F.lit(mask))
    for key in ROUND_KEYS:
        left, right = right, left.bitwiseXOR(F.shiftright(right * key + key, HALF_BITS // 2).bitwiseAND(F.lit(mask)))
    return F.shiftleft(left, HALF_BITS) + right


def booking_reference(ts: Column, request_id: Column) -> Column:
    """``BK``, the request time in base 36, and nine base-36 digits that tell every request id below 2^46 from all others.

    The digits do not repeat for different ids, so references are unique as long as request ids are.
    """
    stamp = F.conv(F.unix_millis(ts.cast("timestamp")).cast("string"), 10, 36)
    digits = F.conv(scrambled(request_id.cast("bigint")).cast("string"), 10, 36)
    return F.concat(F.lit("BK"), stamp, F.lpad(digits, 9, "0"))
