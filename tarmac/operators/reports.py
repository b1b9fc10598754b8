"""Reports: aggregations over table snapshots. ``as_of`` stands for today."""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.expr import (
    ON_TIME_FLIGHT,
    day,
    growth_pct,
    hours_and_minutes,
    in_month,
    is_paid,
    midnight,
    money,
    class_price,
    pct_round,
    since_months,
)
from tarmac.plans.airline import (
    booked_seats,
    fleet_seats,
    passengers_per_booking,
    route_totals,
    with_aircraft,
    with_airports,
)
from tarmac.plans.combine import as_array, asked_for, one_row
from tarmac.schemas import BOOKING_MONTH
from tarmac.sources.work import stored

TREND_MONTHS = 6


def _confirmed() -> Column:
    return F.col("status") == "confirmed"


def _since(bookings: DataFrame, as_of: date | str, back: int) -> DataFrame:
    """Skip the month partitions that end before the month ``back`` months before ``as_of``, where there are any."""
    if BOOKING_MONTH not in bookings.columns:
        return bookings
    return bookings.where(F.col(BOOKING_MONTH) >= F.date_format(F.add_months(day(as_of), -back), "yyyy-MM"))


def _until(bookings: DataFrame, as_of: date | str) -> DataFrame:
    """Skip the month partitions that begin after the month of ``as_of``, where there are any."""
    if BOOKING_MONTH not in bookings.columns:
        return bookings
    return bookings.where(F.col(BOOKING_MONTH) <= F.date_format(day(as_of), "yyyy-MM"))


def _this_month(bookings: DataFrame, as_of: date | str) -> DataFrame:
    return _until(_since(bookings, as_of, 0), as_of).where(in_month(F.col("booking_date"), as_of))


def _month(as_of: date | str, back: int = 0) -> Column:
    return F.date_format(F.add_months(day(as_of), -back), "yyyy-MM")


def _by_month(bookings: DataFrame, as_of: date | str, **totals: Column) -> DataFrame:
    recent = _since(bookings, as_of, TREND_MONTHS).where(since_months(F.col("booking_date"), as_of, TREND_MONTHS))
    return (
        recent.groupBy(F.date_format("booking_date", "yyyy-MM").alias("month"))
        .agg(*[c.alias(n) for n, c in totals.items()])
        .orderBy("month")
    )


def _cells(bookings: DataFrame, as_of: date | str, key: str, total: Column, name: str) -> DataFrame:
    """``total`` by ``key``, month and whether the trend counts it: what a report's parts share of one scan."""
    recent = F.coalesce(since_months(F.col("booking_date"), as_of, TREND_MONTHS), F.lit(False))
    month = F.date_format("booking_date", "yyyy-MM")
    return bookings.groupBy(key, month.alias("month"), recent.alias("recent")).agg(total.alias(name))


# Revenue


def total_revenue(bookings: DataFrame) -> DataFrame:
    return bookings.where(is_paid()).agg(money(F.col("total_amount")).alias("total"))


def monthly_revenue(bookings: DataFrame, as_of: date | str) -> DataFrame:
    return total_revenue(_this_month(bookings, as_of))


def _top_revenue(paid: DataFrame, flights: DataFrame, airports: DataFrame, k: int) -> DataFrame:
    totals = route_totals(
        paid,
        flights,
        airports,
        partial={"revenue": F.sum("total_amount")},
        combine={"revenue": F.col("revenue").cast("decimal(38,2)")},
    )
    revenue = F.coalesce("revenue", F.lit(0)).cast("decimal(38,2)").alias("revenue")
    return totals.select("route", revenue).orderBy(F.desc("revenue"), "route").limit(k)


def revenue_by_route(bookings: DataFrame, flights: DataFrame, airports: DataFrame, k: int = 5) -> DataFrame:
    return _top_revenue(bookings.where(is_paid()), flights, airports, k)


def route_revenue(bookings: DataFrame, flights: DataFrame, airports: DataFrame) -> DataFrame:
    return revenue_by_route(bookings, flights, airports, k=10)


def revenue_trend(bookings: DataFrame, as_of: date | str) -> DataFrame:
    return _by_month(bookings.where(is_paid()), as_of, revenue=money(F.col("total_amount")))


def _two_months(bookings: DataFrame, as_of: date | str) -> DataFrame:
    ts = F.col("booking_date")
    return _until(_since(bookings, as_of, 1), as_of).where(in_month(ts, as_of) | in_month(ts, as_of, back=1))


def revenue_growth(bookings: DataFrame, as_of: date | str) -> DataFrame:
    ts, amount = F.col("booking_date"), F.col("total_amount")
    sums = _two_months(bookings.where(is_paid()), as_of).agg(
        money(F.when(in_month(ts, as_of), amount)).alias("current"),
        money(F.when(in_month(ts, as_of, back=1), amount)).alias("previous"),
    )
    return sums.select("current", "previous", growth_pct(F.col("current"), F.col("previous")).alias("growth"))


def revenue_report(bookings: DataFrame, flights: DataFrame, airports: DataFrame, as_of: date | str) -> DataFrame:
    """All parts come from one scan of the bookings, reduced by flight and month and stored."""
    amount = F.sum("total_amount")
    paid = stored(_cells(bookings.where(is_paid()), as_of, "flight_id", amount, "total_amount"), "paid")
    return revenue_from_cells(paid, paid, flights, airports, as_of)


def revenue_from_cells(
    by_month: DataFrame, by_flight: DataFrame, flights: DataFrame, airports: DataFrame, as_of: date | str
) -> DataFrame:
    """The revenue report from sums ``total_amount`` of paid bookings: by month and ``recent``, and by flight."""
    amount, month = F.col("total_amount"), F.col("month")
    sums = (
        by_month.agg(
            money(amount).alias("total_revenue"),
            money(F.when(month == _month(as_of), amount)).alias("monthly_revenue"),
            money(F.when(month == _month(as_of, 1), amount)).alias("previous"),
        )
        .withColumn("growth", growth_pct(F.col("monthly_revenue"), F.col("previous")))
        .drop("previous")
    )
    by_route = _top_revenue(by_flight, flights, airports, 5)
    trend = by_month.where("recent").groupBy("month").agg(money(amount).alias("revenue"))
    return one_row(
        sums,
        as_array(by_route, [-F.col("revenue"), F.col("route")], ["route", "revenue"], "revenue_by_route"),
        as_array(trend, [month], ["month", "revenue"], "revenue_trend"),
    )


# Bookings


def confirmed_bookings(bookings: DataFrame) -> DataFrame:
    return bookings.where(_confirmed()).agg(F.count("*").alias("total"))


def monthly_confirmed_bookings(bookings: DataFrame, as_of: date | str) -> DataFrame:
    return confirmed_bookings(_this_month(bookings, as_of))


def all_bookings_counts(bookings: DataFrame, as_of: date | str) -> DataFrame:
    return bookings.agg(
        F.count("*").alias("total"), F.count_if(in_month(F.col("booking_date"), as_of)).alias("monthly")
    )


def booking_status_breakdown(bookings: DataFrame) -> DataFrame:
    return bookings.groupBy("status").agg(F.count("*").alias("count"))


def booking_trend(bookings: DataFrame, as_of: date | str) -> DataFrame:
    return _by_month(bookings, as_of, count=F.count("*"))


def booking_growth(bookings: DataFrame, as_of: date | str) -> DataFrame:
    ts = F.col("booking_date")
    counts = _two_months(bookings, as_of).agg(
        F.count_if(in_month(ts, as_of)).alias("current"), F.count_if(in_month(ts, as_of, back=1)).alias("previous")
    )
    return counts.select("current", "previous", growth_pct(F.col("current"), F.col("previous")).alias("growth"))


def bookings_report(bookings: DataFrame, as_of: date | str) -> DataFrame:
    """One scan: counts by status and month, then all, by status and by month from these few."""
    return bookings_from_cells(_cells(bookings, as_of, "status", F.count("*"), "n"), as_of)


def bookings_from_cells(cells: DataFrame, as_of: date | str) -> DataFrame:
    """The bookings report from counts ``n`` by status, month and ``recent``."""
    cells = cells.withColumns(
        {f"n{back}": F.when(F.col("month") == _month(as_of, back), F.col("n")) for back in (0, 1)}
    )
    parts = cells.groupingSets([[], ["status"], ["month", "recent"]], "status", "month", "recent").agg(
        F.grouping_id().alias("level"), *[F.sum(c).alias(c) for c in ("n", "n0", "n1")]
    )
    # Bits of the level stand for the columns that a row sums over: status, month, recent.
    whole, by_status, by_month = (F.col("level") == level for level in (0b111, 0b011, 0b100))

    def total(c: str) -> Column:
        return F.coalesce(F.max(F.when(whole, F.col(c))), F.lit(0))

    def listed(of: Column, key: str) -> Column:
        return F.sort_array(F.collect_list(F.when(of, F.struct(key, F.col("n").alias("count")))))

    counts = parts.agg(
        total("n").alias("total_bookings"),
        total("n0").alias("monthly_bookings"),
        total("n1").alias("previous"),
        listed(by_status, "status").alias("booking_status"),
        listed(by_month & F.col("recent"), "month").alias("booking_trend"),
    )
    growth = growth_pct(F.col("monthly_bookings"), F.col("previous")).alias("growth")
    return counts.select("total_bookings", "monthly_bookings", growth, "booking_status", "booking_trend")


# Routes


def _popular(cells: DataFrame, flights: DataFrame, airports: DataFrame, *keys: str) -> DataFrame:
    """Bookings by route, from counts ``n`` of confirmed ones that have a flight_id."""
    return route_totals(
        cells,
        flights,
        airports,
        partial={"booking_count": F.sum("n")},
        combine={"booking_count": F.col("booking_count")},
        keys=("from_city", "to_city", *keys),
    )


def _popular_cities(cells: DataFrame, flights: DataFrame, airports: DataFrame, k: int) -> DataFrame:
    totals = _popular(cells, flights, airports).select("route", "booking_count")
    return totals.orderBy(F.desc("booking_count"), "route").limit(k)


def popular_routes_city(bookings: DataFrame, flights: DataFrame, airports: DataFrame, k: int = 3) -> DataFrame:
    """Most booked city pairs; airports of one city count together."""
    return _popular_cities(_confirmed_cells(bookings, "flight_id"), flights, airports, k)


def _popular_airports(cells: DataFrame, flights: DataFrame, airports: DataFrame, k: int) -> DataFrame:
    from_code, to_code = F.col("from_airport_code").alias("from_code"), F.col("to_airport_code").alias("to_code")
    totals = _popular(cells, flights, airports, "from_airport_code", "to_airport_code")
    return (
        totals.select("route", from_code, to_code, "booking_count")
        .orderBy(F.desc("booking_count"), "route", "from_code", "to_code")
        .limit(k)
    )


def popular_routes_airport(bookings: DataFrame, flights: DataFrame, airports: DataFrame, k: int = 10) -> DataFrame:
    """Most booked airport pairs."""
    return _popular_airports(_confirmed_cells(bookings, "flight_id"), flights, airports, k)


def _avg_prices(cells: DataFrame, flights: DataFrame, airports: DataFrame, k: int) -> DataFrame:
    price = class_price(F.col("class"))
    totals = route_totals(
        cells,
        flights,
        airports,
        partial={"n": F.sum("n")},
        combine={
            "price_sum": (price.cast("decimal(18,2)") * F.col("n")).cast("decimal(38,2)"),
            "priced": F.when(price.isNotNull(), F.col("n")),
        },
        by=("class",),
    )
    mean = F.try_divide(F.col("price_sum").cast("double"), F.col("priced").cast("double"))
    return totals.select("route", mean.alias("avg_price")).orderBy(F.desc("avg_price"), "route").limit(k)


def route_avg_price(bookings: DataFrame, flights: DataFrame, airports: DataFrame, k: int = 10) -> DataFrame:
    """City pairs by the mean list price of the booked class; bookings without a list price do not count."""
    return _avg_prices(_confirmed_cells(bookings, "flight_id", "class"), flights, airports, k)


def _confirmed_cells(bookings: DataFrame, *keys: str, **totals: Column) -> DataFrame:
    confirmed = bookings.where(_confirmed()).groupBy(*keys)
    return confirmed.agg(F.count("*").alias("n"), *[c.alias(n) for n, c in totals.items()])


def routes_report(bookings: DataFrame, flights: DataFrame, airports: DataFrame) -> DataFrame:
    """The three lists come from one scan of the bookings, reduced by flight and class and stored."""
    paid = {"paid": F.count_if(is_paid()), "total_amount": F.sum(F.when(is_paid(), F.col("total_amount")))}
    cells = stored(_confirmed_cells(bookings, "flight_id", "class", **paid), "confirmed")
    return routes_from_cells(cells, flights, airports)


def routes_from_cells(cells: DataFrame, flights: DataFrame, airports: DataFrame) -> DataFrame:
    """The routes report from confirmed bookings by flight and class: ``n``, the ``paid`` among them, their sum."""
    popular = _popular_airports(cells, flights, airports, 10)
    prices = _avg_prices(cells, flights, airports, 10)
    revenue = _top_revenue(cells.where("paid > 0"), flights, airports, 10)
    route = F.col("route")
    return one_row(
        as_array(
            popular,
            [-F.col("booking_count"), route, F.col("from_code"), F.col("to_code")],
            ["route", "from_code", "to_code", "booking_count"],
            "popular_routes",
        ),
        as_array(prices, [F.col("avg_price").isNull(), -F.col("avg_price"), route], ["route", "avg_price"], "route_performance"),
        as_array(revenue, [-F.col("revenue"), route], ["route", "revenue"], "route_revenue"),
    )


# Performance


def _status_counts() -> list[Column]:
    return [
        F.count_if(F.col("status").isin(*ON_TIME_FLIGHT)).alias("on_time"),
        F.count_if(F.col("status") == "delayed").alias("delayed"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled"),
    ]


def _on_time_counts(flights: DataFrame) -> DataFrame:
    return flights.agg(*_status_counts())


def _fleet_figures(flights: DataFrame, aircraft: DataFrame) -> DataFrame:
    """One row from one scan of the flights: counts by status, minutes of on-time flights, seats of all and on-time ones."""
    minutes = F.when(F.col("status").isin(*ON_TIME_FLIGHT), _minutes())
    per_aircraft = flights.groupBy("aircraft_id").agg(
        *_status_counts(), F.count("*").alias("flights"), F.sum(minutes).alias("minutes"), F.count(minutes).alias("timed")
    )
    seats = F.col("capacity").cast("long")
    figures = {c: F.col(c) for c in ("on_time", "delayed", "cancelled", "minutes", "timed")}
    figures |= {"seats_all": seats * F.col("flights"), "seats_on_time": seats * F.col("on_time")}
    # Flights of an unknown aircraft offer no seats, but count otherwise.
    known = per_aircraft.join(aircraft.select("aircraft_id", "capacity"), "aircraft_id", "left")
    return known.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in figures.items()])


def on_time_rate(flights: DataFrame) -> DataFrame:
    """On-time share of on-time and delayed flights; cancelled ones are left out."""
    on_time, delayed = F.col("on_time"), F.col("delayed")
    return _on_time_counts(flights).select(pct_round(on_time, on_time + delayed).alias("on_time_rate"))


def on_time_performance(flights: DataFrame) -> DataFrame:
    """On-time share with cancelled flights in the denominator, and the counts."""
    total = F.col("on_time") + F.col("delayed") + F.col("cancelled")
    return _on_time_counts(flights).select(
        pct_round(F.col("on_time"), total).alias("rate"), "on_time", "delayed", "cancelled", total.alias("total")
    )


def _seats_booked(bookings: DataFrame, booking_passengers: DataFrame) -> DataFrame:
    held = bookings.where(F.col("status") != "cancelled").select("booking_id")
    return (
        passengers_per_booking(booking_passengers)
        .join(held, "booking_id")
        .agg(F.coalesce(F.sum("passenger_count"), F.lit(0)).alias("booked"))
    )


def _seats_offered(flights: DataFrame, aircraft: DataFrame, flights_counted: str) -> DataFrame:
    seats = F.sum(F.col("capacity").cast("long") * F.col(flights_counted))
    return fleet_seats(flights, aircraft).agg(F.coalesce(seats, F.lit(0)).alias("total"))


def _occupancy(booked: DataFrame, offered: DataFrame) -> DataFrame:
    return one_row(booked, offered).select(
        pct_round(F.col("booked"), F.col("total")).alias("rate"), "booked", "total"
    )


def occupancy_all_flights(
    bookings: DataFrame, booking_passengers: DataFrame, flights: DataFrame, aircraft: DataFrame
) -> DataFrame:
    """Booked seats against the capacity of all flights."""
    return _occupancy(_seats_booked(bookings, booking_passengers), _seats_offered(flights, aircraft, "flight_count"))


def occupancy_active_flights(
    bookings: DataFrame, booking_passengers: DataFrame, flights: DataFrame, aircraft: DataFrame
) -> DataFrame:
    """Booked seats of all flights against the capacity of the on-time ones; may pass 100."""
    return _occupancy(_seats_booked(bookings, booking_passengers), _seats_offered(flights, aircraft, "active_count"))


def _minutes() -> Column:
    return F.timestamp_diff("MINUTE", F.col("departure_datetime"), F.col("arrival_datetime"))


def avg_flight_time(flights: DataFrame) -> DataFrame:
    minutes = _minutes()
    mean = F.try_divide(F.sum(minutes).cast("double"), F.count(minutes).cast("double"))
    return (
        flights.where(F.col("status").isin(*ON_TIME_FLIGHT))
        .agg(F.coalesce(mean, F.lit(0.0)).alias("avg_minutes"))
        .select("avg_minutes", hours_and_minutes(F.col("avg_minutes")).alias("avg_flight_time"))
    )


def performance_report(
    bookings: DataFrame, booking_passengers: DataFrame, flights: DataFrame, aircraft: DataFrame
) -> DataFrame:
    figures = one_row(_seats_booked(bookings, booking_passengers), _fleet_figures(flights, aircraft))
    counted = F.col("on_time") + F.col("delayed") + F.col("cancelled")
    mean = F.try_divide(F.col("minutes").cast("double"), F.col("timed").cast("double"))
    return figures.select(
        pct_round(F.col("on_time"), counted).alias("on_time_rate"),
        "on_time",
        "delayed",
        "cancelled",
        counted.alias("flights_counted"),
        pct_round(F.col("booked"), F.col("seats_on_time")).alias("occupancy_rate"),
        F.col("booked").alias("seats_booked"),
        F.col("seats_on_time").alias("seats_total"),
        hours_and_minutes(mean).alias("avg_flight_time"),
    )


# Dashboards


def overview(
    bookings: DataFrame,
    booking_passengers: DataFrame,
    flights: DataFrame,
    aircraft: DataFrame,
    airports: DataFrame,
    as_of: date | str,
) -> DataFrame:
    """Revenue, bookings and routes come from one scan of the bookings, reduced by flight and stored."""
    this_month = in_month(F.col("booking_date"), as_of)
    paid = F.when(is_paid(), F.col("total_amount"))
    cells = _confirmed_cells(
        bookings,
        "flight_id",
        amount=F.sum(paid),
        amount_month=F.sum(F.when(this_month, paid)),
        n_month=F.count_if(this_month),
    )
    cells = stored(cells, "confirmed")
    totals = cells.agg(
        money(F.col("amount")).alias("revenue_total"),
        money(F.col("amount_month")).alias("revenue_monthly"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("bookings_total"),
        F.coalesce(F.sum("n_month"), F.lit(0)).alias("bookings_monthly"),
    )
    return overview_from_cells(
        totals, _seats_booked(bookings, booking_passengers), cells, flights, aircraft, airports
    )


def overview_from_cells(
    totals: DataFrame,
    seats: DataFrame,
    confirmed: DataFrame,
    flights: DataFrame,
    aircraft: DataFrame,
    airports: DataFrame,
) -> DataFrame:
    """The overview from its one row of ``totals``, the seats ``booked`` and confirmed bookings ``n`` by flight."""
    routes = _popular_cities(confirmed, flights, airports, 3)
    fleet = one_row(seats, _fleet_figures(flights, aircraft))
    on_time = F.col("on_time")
    return one_row(
        totals,
        as_array(routes, [-F.col("booking_count"), F.col("route")], ["route", "booking_count"], "popular_routes"),
        fleet.select(
            pct_round(on_time, on_time + F.col("delayed")).alias("on_time_rate"),
            pct_round(F.col("booked"), F.col("seats_all")).alias("occupancy_rate"),
        ),
    )


def admin_stats(users: DataFrame, flights: DataFrame, bookings: DataFrame, aircraft: DataFrame) -> DataFrame:
    return one_row(
        users.agg(F.count_if(F.col("role") == "user").alias("total_users")),
        flights.agg(F.count("*").alias("total_flights")),
        bookings.agg(
            F.count_if(_confirmed()).alias("total_bookings"),
            money(F.when(is_paid(), F.col("total_amount"))).alias("total_revenue"),
            F.count_if(F.col("status") == "pending").alias("pending_bookings"),
        ),
        aircraft.agg(F.count_if(F.col("status") == "active").alias("active_aircraft")),
    )


def hot_flights(
    bookings: DataFrame,
    booking_passengers: DataFrame,
    flights: DataFrame,
    aircraft: DataFrame,
    airports: DataFrame,
    as_of: date | str,
    k: int = 5,
) -> DataFrame:
    """The ``k`` most booked flights departing on or after ``as_of``, with their occupancy.

    Confirmed bookings rank the flights; seats of every booking that is not cancelled fill them. Seats are counted
    for the ``k`` flights only. Those, and then their bookings, are stored, so that Spark knows their size when it
    plans the next join and the large tables are filtered where they lie if it is small.
    """
    coming = flights.where(F.col("departure_datetime") >= midnight(day(as_of)))
    per_flight = (
        bookings.where(_confirmed())
        .groupBy("flight_id")
        .agg(F.count("*").alias("booking_count"), F.sum("total_amount").alias("total_revenue"))
    )
    top = (
        with_aircraft(with_airports(coming, airports), aircraft)
        .join(per_flight, "flight_id", "left")
        .withColumn("booking_count", F.coalesce("booking_count", F.lit(0)))
        .withColumn("total_revenue", F.coalesce("total_revenue", F.lit(0)).cast("decimal(38,2)"))
        .orderBy(F.desc("booking_count"), F.desc("total_revenue"), "flight_id")
        .limit(k)
    )
    top = stored(top, "hot-flights")
    theirs = stored(asked_for(bookings, top, "flight_id").select("booking_id", "flight_id", "status"), "hot-bookings")
    seats = booked_seats(theirs, booking_passengers, few=True)
    booked = F.coalesce("booked_seats", F.lit(0))
    return (
        top.join(seats, "flight_id", "left")
        .select(
            "flight_id",
            "flight_number",
            "departure_datetime",
            "arrival_datetime",
            "status",
            "base_price",
            "business_price",
            "first_class_price",
            F.col("from_airport_code").alias("from_code"),
            "from_name",
            "from_city",
            "from_country",
            F.col("to_airport_code").alias("to_code"),
            "to_name",
            "to_city",
            "to_country",
            "booking_count",
            "total_revenue",
            "aircraft_model",
            "capacity",
            booked.alias("booked_seats"),
            pct_round(booked, F.col("capacity")).alias("occupancy_rate"),
        )
        .orderBy(F.desc("booking_count"), F.desc("total_revenue"), "flight_id")
    )
