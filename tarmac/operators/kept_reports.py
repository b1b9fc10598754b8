"""Reports that are kept up to date from feeds: no report reads the bookings.

Cells hold the number, the money and the seats of bookings at two grains, by flight and class and by day of booking,
each with the state (status, payment status). A batch of accepted changes or new bookings becomes cells of its own, in
which a booking that leaves a state counts as minus one; merged into the stored cells they give the cells of the new
bookings table. A batch must be merged once: write the merged cells next to the old ones and switch to them together
with the bookings table.

Day cells are as many as days and states, flight cells as many as flights, classes and states, whatever the number of
bookings. A null date, flight, class or state is a value of its own; a null amount is no money.
"""

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.expr import in_month, is_paid, money, since_months
from tarmac.operators import reports
from tarmac.operators.booking_changes import left_behind
from tarmac.plans.airline import passengers_per_booking
from tarmac.plans.combine import asked_for
from tarmac.sources.work import stored

BY_FLIGHT, BY_DAY = "flight", "day"
STATE = ["status", "payment_status"]
PLACE = ["flight_id", "class", "booked_on"]
MEASURES = {"n": "bigint", "amount": "decimal(38,2)", "seats": "bigint"}
CELL_COLUMNS = ["grain", *PLACE, *STATE, *MEASURES]


def _sums() -> list[Column]:
    return [F.sum(m).cast(kind).alias(m) for m, kind in MEASURES.items()]


def _reduced(rows: DataFrame) -> DataFrame:
    """Rows with measures as cells of both grains, from one pass; cells that cancel out are left out."""
    grains = [["flight_id", "class", *STATE], ["booked_on", *STATE]]
    cells = rows.groupingSets(grains, *PLACE, *STATE).agg(F.grouping("flight_id").alias("_all_flights"), *_sums())
    grain = F.when(F.col("_all_flights") == 1, BY_DAY).otherwise(BY_FLIGHT)
    return cells.where(_counts()).withColumn("grain", grain).select(CELL_COLUMNS)


def _counts() -> Column:
    return reduce(lambda a, b: a | b, [F.col(m) != 0 for m in MEASURES])


def _measured(bookings: DataFrame, booking_passengers: DataFrame, *others: str | Column) -> DataFrame:
    """Bookings with their place and measures."""
    counted = bookings.join(passengers_per_booking(booking_passengers), "booking_id", "left")
    return counted.select(
        "flight_id",
        "class",
        F.to_date("booking_date").alias("booked_on"),
        F.lit(1).cast("bigint").alias("n"),
        F.coalesce("total_amount", F.lit(0)).cast(MEASURES["amount"]).alias("amount"),
        F.coalesce("passenger_count", F.lit(0)).cast("bigint").alias("seats"),
        *others,
    )


def cells_of(bookings: DataFrame, booking_passengers: DataFrame) -> DataFrame:
    """Cells of whole tables, or of the new rows of an admission (``booking_rows`` and ``link_rows``)."""
    return _reduced(_measured(bookings, booking_passengers, *STATE))


def cells_of_changes(bookings: DataFrame, booking_passengers: DataFrame, accepted: DataFrame) -> DataFrame:
    """What ``accepted`` booking changes add to the cells of ``bookings``, the table before them.

    The changes of a booking are composed to its last state first, map-side. Bookings that end in another state are
    fetched by key and stored, so that their passengers can be fetched by a batch of known size.
    """
    was = F.struct(*STATE)
    becomes = F.struct(
        F.coalesce("new_status", "status").alias("status"),
        F.coalesce("new_payment", "payment_status").alias("payment_status"),
    )
    last = stored(left_behind(accepted).drop("changed_at"), "last-states")
    moved = bookings.join(last, "booking_id").select(
        "booking_id", "flight_id", "class", "booking_date", "total_amount", was.alias("was"), becomes.alias("becomes")
    )
    moved = stored(moved.where(~F.col("was").eqNullSafe(F.col("becomes"))), "moved-bookings")
    sides = F.array(
        *[
            F.struct(F.lit(sign).alias("sign"), *[F.col(side)[s].alias(s) for s in STATE])
            for sign, side in ((-1, "was"), (1, "becomes"))
        ]
    )
    rows = _measured(moved, asked_for(booking_passengers, moved, "booking_id"), F.inline(sides))
    return _reduced(rows.withColumns({m: F.col(m) * F.col("sign") for m in MEASURES}))


def merged(cells: DataFrame, *batches: DataFrame) -> DataFrame:
    """``cells`` after ``batches`` of cells, in any order; cells that are left without bookings go."""
    every = reduce(lambda a, b: a.unionByName(b), batches, cells)
    return every.groupBy("grain", *PLACE, *STATE).agg(*_sums()).where(_counts()).select(CELL_COLUMNS)


def _days(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("grain") == BY_DAY)


def _flights(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("grain") == BY_FLIGHT)


def _of_month(cells: DataFrame, as_of: date | str, key: str, measure: str, name: str) -> DataFrame:
    """A measure of day cells by ``key``, month and whether the trend counts it."""
    recent = F.coalesce(since_months(F.col("booked_on"), as_of, reports.TREND_MONTHS), F.lit(False))
    month = F.date_format("booked_on", "yyyy-MM")
    return _days(cells).groupBy(key, month.alias("month"), recent.alias("recent")).agg(F.sum(measure).alias(name))


def overview(
    cells: DataFrame, flights: DataFrame, aircraft: DataFrame, airports: DataFrame, as_of: date | str
) -> DataFrame:
    confirmed, this_month = F.col("status") == "confirmed", in_month(F.col("booked_on"), as_of)
    totals = _days(cells).agg(
        money(F.when(is_paid(), F.col("amount"))).alias("revenue_total"),
        money(F.when(is_paid() & this_month, F.col("amount"))).alias("revenue_monthly"),
        F.coalesce(F.sum(F.when(confirmed, F.col("n"))), F.lit(0)).alias("bookings_total"),
        F.coalesce(F.sum(F.when(confirmed & this_month, F.col("n"))), F.lit(0)).alias("bookings_monthly"),
    )
    held = _days(cells).where(F.col("status") != "cancelled")
    seats = held.agg(F.coalesce(F.sum("seats"), F.lit(0)).alias("booked"))
    by_flight = _flights(cells).where(confirmed).select("flight_id", "n")
    return reports.overview_from_cells(totals, seats, by_flight, flights, aircraft, airports)


def revenue_report(cells: DataFrame, flights: DataFrame, airports: DataFrame, as_of: date | str) -> DataFrame:
    paid = cells.where(is_paid())
    by_month = _of_month(paid, as_of, "status", "amount", "total_amount")
    by_flight = _flights(paid).select("flight_id", F.col("amount").alias("total_amount"))
    return reports.revenue_from_cells(by_month, by_flight, flights, airports, as_of)


def bookings_report(cells: DataFrame, as_of: date | str) -> DataFrame:
    return reports.bookings_from_cells(_of_month(cells, as_of, "status", "n", "n"), as_of)


def routes_report(cells: DataFrame, flights: DataFrame, airports: DataFrame) -> DataFrame:
    paid = {"paid": F.sum(F.when(is_paid(), F.col("n"))), "total_amount": F.sum(F.when(is_paid(), F.col("amount")))}
    confirmed = _flights(cells).where(F.col("status") == "confirmed").groupBy("flight_id", "class")
    by_flight = confirmed.agg(F.sum("n").alias("n"), *[c.alias(name) for name, c in paid.items()])
    return reports.routes_from_cells(by_flight, flights, airports)
