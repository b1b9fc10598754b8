"""Enriched listings and lookups.

Every lookup takes its key as an optional parameter: with it the filter reaches the scans, without it the same plan
serves all keys at once.
"""

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.collation import lower_or_compared
from tarmac.functions.expr import OPEN_FLIGHT, class_price, day, lenient_int
from tarmac.plans import page_directory, paging
from tarmac.plans.airline import booked_seats, with_aircraft, with_airports
from tarmac.plans.combine import asked_for
from tarmac.plans.running import running
from tarmac.sources.work import stored

# Page sizes of the flight administration.
DEFAULT_LIMIT, MAX_LIMIT = 50, 100
# Passengers in one row of nested ones.
ARRAY_WIDTH = 1000

FLIGHT_COLUMNS = [
    "flight_id",
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
    "created_at",
    "updated_at",
]
BOOKING_COLUMNS = [
    "booking_id",
    "booking_reference",
    "user_id",
    "flight_id",
    "booking_date",
    "number_of_passengers",
    "class",
    "total_amount",
    "status",
    "payment_status",
    "payment_method",
    "created_at",
    "updated_at",
]
PASSENGER_COLUMNS = ["passenger_id", "first_name", "last_name", "date_of_birth", "passport_number", "nationality"]


def codes(*names: str) -> list[Column | str]:
    """Both ends of a flight: the airport codes under their listing names, then the ``names`` of either end."""
    return [
        c
        for side in ("from", "to")
        for c in (F.col(f"{side}_airport_code").alias(f"{side}_code"), *[f"{side}_{n}" for n in names])
    ]


# Flights


def available(df: DataFrame, bookings: DataFrame, booking_passengers: DataFrame, few: bool) -> DataFrame:
    """Free seats of the flights in ``df``; ``few`` restricts the seat count to their bookings first."""
    if few:
        bookings = asked_for(bookings, df, "flight_id")
    free = F.col("capacity") - F.coalesce("booked_seats", F.lit(0))
    return df.join(booked_seats(bookings, booking_passengers, few), "flight_id", "left").withColumn(
        "available_seats", F.greatest(F.lit(0), free).cast("long")
    )


def flight_search(
    flights: DataFrame,
    airports: DataFrame,
    aircraft: DataFrame,
    bookings: DataFrame,
    booking_passengers: DataFrame,
    from_code: str | None = None,
    to_code: str | None = None,
    departure: date | str | None = None,
    passengers: int | str = 1,
    flight_class: str = "economy",
) -> DataFrame:
    """Open flights with free seats and the price for ``passengers`` in ``flight_class``, by departure.

    Flights without enough seats stay in the list.
    """
    found = flights.where(F.col("status").isin(*OPEN_FLIGHT))
    if from_code:
        found = found.where(F.col("from_airport_code") == from_code)
    if to_code:
        found = found.where(F.col("to_airport_code") == to_code)
    if departure:
        found = found.where(F.to_date("departure_datetime") == day(departure))
    found = with_aircraft(with_airports(found, airports), aircraft)
    found = available(found, bookings, booking_passengers, few=bool(from_code or to_code or departure))
    price = class_price(F.lit(flight_class))
    return found.select(
        "flight_id",
        "flight_number",
        "departure_datetime",
        "arrival_datetime",
        "status",
        "base_price",
        "business_price",
        "first_class_price",
        "aircraft_id",
        "aircraft_model",
        "capacity",
        *codes("name", "city", "country"),
        price.alias("price"),
        "available_seats",
        (price.cast("decimal(18,2)") * lenient_int(F.lit(str(passengers)))).cast("decimal(38,2)").alias("total_price"),
    ).orderBy("departure_datetime", "flight_id")


def flight_detail(
    flights: DataFrame,
    airports: DataFrame,
    aircraft: DataFrame,
    bookings: DataFrame,
    booking_passengers: DataFrame,
    flight_id: int | None = None,
) -> DataFrame:
    """Every column of a flight of any status, its aircraft, airports and free seats."""
    found = flights if flight_id is None else flights.where(F.col("flight_id") == flight_id)
    found = with_aircraft(with_airports(found, airports), aircraft)
    found = available(found, bookings, booking_passengers, few=flight_id is not None)
    return found.select(
        *FLIGHT_COLUMNS, "aircraft_model", "capacity", *codes("name", "city", "country"), "available_seats"
    )


def flight_status(
    flights: DataFrame, airports: DataFrame, aircraft: DataFrame, flight_number: str | None = None
) -> DataFrame:
    """The flight with a number; the lowest flight id where a number is not unique."""
    found = flights if flight_number is None else flights.where(F.col("flight_number") == flight_number)
    found = with_aircraft(with_airports(found, airports), aircraft)
    place = F.row_number().over(Window.partitionBy("flight_number").orderBy("flight_id"))
    return (
        found.withColumn("_place", place)
        .where(F.col("_place") == 1)
        .select(
            *FLIGHT_COLUMNS,
            "aircraft_model",
            "from_name",
            "from_city",
            "from_country",
            "to_name",
            "to_city",
            "to_country",
        )
    )


def _matching_flights(
    flights: DataFrame, airports: DataFrame, search: str | None, collation: str | None = None
) -> DataFrame:
    found = with_airports(flights, airports)
    needle = (search or "").strip()
    if needle:
        searched = ("flight_number", "from_city", "from_name", "to_city", "to_name")
        hit = F.lit(False)
        for name in searched:
            hit = hit | lower_or_compared(F.col(name), collation).contains(lower_or_compared(F.lit(needle), collation))
        found = found.where(hit)
    return found


def page_bounds(page: int | None = None, limit: int | None = None) -> tuple[int, int]:
    """Page number and size after defaults and limits; 0 counts as not given."""
    return max(1, page or 1), min(MAX_LIMIT, max(1, limit or DEFAULT_LIMIT))


def _listed_flights(
    flights: DataFrame, airports: DataFrame, aircraft: DataFrame, search: str | None, collation: str | None
) -> DataFrame:
    return with_aircraft(_matching_flights(flights, airports, search, collation), aircraft).select(
        *FLIGHT_COLUMNS,
        "aircraft_model",
        "capacity",
        "from_name",
        "from_city",
        "from_country",
        "to_name",
        "to_city",
        "to_country",
    )


def admin_flights_page(
    flights: DataFrame,
    airports: DataFrame,
    aircraft: DataFrame,
    page: int | None = None,
    limit: int | None = None,
    search: str | None = None,
    collation: str | None = None,
) -> DataFrame:
    """One page of flights, latest departure first; ``search`` is a literal part of a number, city or airport name.

    It is found by ``collation``, without one in lower case.
    """
    page, limit = page_bounds(page, limit)
    found = _listed_flights(flights, airports, aircraft, search, collation)
    order = [F.desc("departure_datetime"), F.asc("flight_id")]
    buckets = [*paging.latest_first("departure_datetime"), paging.id_block("flight_id")]
    return paging.page(found, order, buckets, (page - 1) * limit, limit)


def flight_page_directory(
    flights: DataFrame,
    airports: DataFrame,
    aircraft: DataFrame,
    limit: int | None = None,
    search: str | None = None,
    collation: str | None = None,
) -> DataFrame:
    """The bounds of all pages of ``admin_flights_page`` with this ``limit`` and search: one row for each page.

    Keep it as a table: ``flights_of_page`` then finds any page without counting. It holds for the flights it was made of.
    """
    found = _listed_flights(flights, airports, aircraft, search, collation)
    return page_directory.directory(found, "departure_datetime", "flight_id", page_bounds(limit=limit)[1])


def flights_of_page(
    directory: DataFrame,
    flights: DataFrame,
    airports: DataFrame,
    aircraft: DataFrame,
    page: int | None = None,
    search: str | None = None,
    collation: str | None = None,
) -> DataFrame:
    """A page by its row of ``directory``, which was made with the same search; empty if there is no such page.

    The bounds of that one page come to the driver and reach the scan of the flights as a range.
    """
    bounds = directory.where(F.col("page") == page_bounds(page)[0]).head()
    ts, key = "departure_datetime", "flight_id"
    within = F.lit(False) if bounds is None else page_directory.in_page(bounds, ts, key)
    found = _listed_flights(flights.where(within), airports, aircraft, search, collation)
    return found.orderBy(*page_directory.latest_first(ts, key))


def admin_flights_total(
    flights: DataFrame,
    airports: DataFrame,
    page: int | None = None,
    limit: int | None = None,
    search: str | None = None,
    collation: str | None = None,
) -> DataFrame:
    """Pagination figures of the page; flights with an unknown aircraft count here but are on no page."""
    page, limit = page_bounds(page, limit)
    total = F.count("*")
    return _matching_flights(flights, airports, search, collation).agg(
        F.lit(page).alias("page"),
        F.lit(limit).alias("limit"),
        total.alias("total"),
        F.ceil(total / limit).cast("long").alias("total_pages"),
    )


# Bookings


def on_flights(bookings: DataFrame, flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Bookings with their flight and airports. Flights meet the airports first: the booking rows move once."""
    places = with_airports(
        flights.select(
            "flight_id",
            "flight_number",
            "departure_datetime",
            "arrival_datetime",
            F.col("status").alias("flight_status"),
            "from_airport_code",
            "to_airport_code",
        ),
        airports,
    )
    return bookings.join(places, "flight_id")


def _flight_part() -> list[Column | str]:
    return ["flight_number", "departure_datetime", "arrival_datetime", "flight_status", *codes("name", "city")]


def _with_user(df: DataFrame, users: DataFrame) -> DataFrame:
    return df.join(
        users.select(
            "user_id",
            F.col("first_name").alias("user_first_name"),
            F.col("last_name").alias("user_last_name"),
            F.col("email").alias("user_email"),
        ),
        "user_id",
    )


def _of(bookings: DataFrame, user_id: int | None, status: str | None) -> DataFrame:
    if user_id is not None:
        bookings = bookings.where(F.col("user_id") == user_id)
    if status and status != "all":
        bookings = bookings.where(F.col("status") == status)
    return bookings


def user_bookings(
    bookings: DataFrame,
    flights: DataFrame,
    airports: DataFrame,
    user_id: int | None = None,
    status: str | None = None,
) -> DataFrame:
    """Bookings of a user with flight and airports, newest first; ``status`` 'all' filters nothing."""
    found = on_flights(_of(bookings, user_id, status), flights, airports).select(*BOOKING_COLUMNS, *_flight_part())
    order = [F.desc("booking_date"), F.desc("booking_id")]
    return found.orderBy(*order) if user_id is not None else found.orderBy("user_id", *order)


def admin_bookings(
    bookings: DataFrame, users: DataFrame, flights: DataFrame, airports: DataFrame, status: str | None = None
) -> DataFrame:
    """Bookings of all users with the user's name and e-mail, newest first."""
    found = _with_user(on_flights(_of(bookings, None, status), flights, airports), users)
    return found.select(
        *BOOKING_COLUMNS, "user_first_name", "user_last_name", "user_email", *_flight_part()
    ).orderBy(F.desc("booking_date"), F.desc("booking_id"))


def booking_detail(
    bookings: DataFrame,
    flights: DataFrame,
    airports: DataFrame,
    booking_id: int | None = None,
    user_id: int | None = None,
    users: DataFrame | None = None,
) -> DataFrame:
    """A booking with flight and airports; ``user_id`` admits its owner only, ``users`` adds the user's columns."""
    found = bookings if booking_id is None else bookings.where(F.col("booking_id") == booking_id)
    found = on_flights(_of(found, user_id, None), flights, airports)
    columns = [*BOOKING_COLUMNS, *_flight_part()]
    if users is not None:
        found = _with_user(found, users)
        columns += ["user_first_name", "user_last_name", "user_email"]
    return found.select(columns)


def passenger_rows(booking_passengers: DataFrame, passengers: DataFrame) -> DataFrame:
    """Passengers of bookings, one row each."""
    return booking_passengers.join(passengers.select(PASSENGER_COLUMNS), "passenger_id").select(
        "booking_id", "booking_passenger_id", *PASSENGER_COLUMNS, "seat_number"
    )


def booking_passenger_detail(detail: DataFrame, booking_passengers: DataFrame, passengers: DataFrame) -> DataFrame:
    """Booking details with one row per passenger, at least one per booking. No group is gathered anywhere."""
    rows = passenger_rows(booking_passengers, passengers).withColumnsRenamed(
        {"first_name": "passenger_first_name", "last_name": "passenger_last_name"}
    )
    return detail.join(rows, "booking_id", "left")


def nested_passengers(
    booking_passengers: DataFrame,
    passengers: DataFrame,
    width: int = ARRAY_WIDTH,
    order: tuple[str, ...] = ("booking_passenger_id",),
) -> DataFrame:
    """Passengers of a booking as arrays of structs in ``order``, which must be total inside a booking.

    Row ``part`` of a booking holds its passengers ``part * width`` to ``(part + 1) * width - 1`` in that order, so a
    booking of any size is cut alike and no task gathers more than one part. Bookings are counted first: those of one
    part are gathered where their rows meet, and only wider ones are numbered over all tasks.
    """
    rows = passenger_rows(booking_passengers, passengers).where("booking_id IS NOT NULL")
    # A passenger that stands twice in the table counts twice.
    repeated = passengers.groupBy("passenger_id").count().where("count > 1")
    counted = booking_passengers if repeated.isEmpty() else rows
    sizes = counted.groupBy("booking_id").agg(F.count("*").alias("_size"))
    wide = stored(sizes.where(F.col("_size") > width).select("booking_id"), "wide-bookings")
    if wide.isEmpty():
        return _gathered(rows, width, order)
    narrow = _gathered(rows.join(wide, "booking_id", "left_anti"), width, order)
    return narrow.unionByName(_dealt(asked_for(rows, wide, "booking_id"), width, order))


def _passenger() -> Column:
    return F.struct("booking_passenger_id", *PASSENGER_COLUMNS, "seat_number").alias("passenger")


def _gathered(rows: DataFrame, width: int, order: tuple[str, ...]) -> DataFrame:
    """Parts of bookings that one task can hold whole: their rows move once and then lie by booking."""
    item = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], _passenger())
    whole = (
        rows.repartition("booking_id")
        .groupBy("booking_id")
        .agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["passenger"]).alias("_all"))
    )
    starts = F.sequence(F.lit(1), F.size("_all"), F.lit(width))
    parts = F.transform(starts, lambda start: F.slice("_all", start, F.lit(width)))
    return whole.select("booking_id", F.posexplode(parts).alias("part", "passengers"))


def _dealt(rows: DataFrame, width: int, order: tuple[str, ...]) -> DataFrame:
    """Parts of bookings of any size: the rows are dealt by range, numbered and dealt again by part."""
    placed = running(
        rows.withColumn("_one", F.lit(1)), [F.col("booking_id").asc(), *[F.col(c).asc() for c in order]], {"_place": "_one"}
    )
    first = placed.groupBy("booking_id").agg(F.min("_place").alias("_first"))
    part = F.floor((F.col("_place") - F.col("_first")) / width).cast("int")
    return (
        placed.join(first, "booking_id")
        .withColumn("part", part)
        .repartition("booking_id", "part")
        .groupBy("booking_id", "part")
        .agg(
            F.transform(F.sort_array(F.collect_list(F.struct("_place", _passenger()))), lambda x: x["passenger"]).alias(
                "passengers"
            )
        )
    )


def booking_with_passengers(detail: DataFrame, booking_passengers: DataFrame, passengers: DataFrame) -> DataFrame:
    """Booking details with the nested passengers; an empty array where there are none."""
    wanted = asked_for(booking_passengers, detail, "booking_id")
    nested = nested_passengers(wanted, passengers)
    return (
        detail.join(nested, "booking_id", "left")
        .withColumn("part", F.coalesce("part", F.lit(0)))
        .withColumn("passengers", F.coalesce("passengers", F.array().cast(nested.schema["passengers"].dataType)))
    )


# People and aircraft


def users_public(users: DataFrame, user_id: int | None = None) -> DataFrame:
    """Users without their password, newest first."""
    found = users if user_id is None else users.where(F.col("user_id") == user_id)
    return found.select(
        "user_id",
        "first_name",
        "last_name",
        "email",
        "phone",
        "date_of_birth",
        "address",
        "role",
        "status",
        "created_at",
        "updated_at",
    ).orderBy(F.desc("created_at"), F.desc("user_id"))


def saved_passengers(passengers: DataFrame, user_id: int | None = None) -> DataFrame:
    """Saved passengers of a user, newest first."""
    found = passengers.where(F.col("is_saved") == 1)
    order = [F.desc("created_at"), F.desc("passenger_id")]
    if user_id is not None:
        return found.where(F.col("user_id") == user_id).select(
            *PASSENGER_COLUMNS, "is_saved", "created_at"
        ).orderBy(*order)
    return found.select("user_id", *PASSENGER_COLUMNS, "is_saved", "created_at").orderBy("user_id", *order)


def aircraft_list(aircraft: DataFrame) -> DataFrame:
    return aircraft.select(
        "aircraft_id", "model", "registration", "capacity", "status", "created_at", "updated_at"
    ).orderBy("model", "registration", "aircraft_id")


def active_users(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of ``df`` whose user exists and is active."""
    return df.join(users.where(F.col("status") == "active").select("user_id"), "user_id", "left_semi")
