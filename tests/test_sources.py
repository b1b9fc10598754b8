"""Loading, layouts and the shared folder."""

from types import SimpleNamespace

import pytest

from rows import table
from tarmac.operators import reports
from tarmac.plans.airline import booked_seats, passengers_per_booking
from tarmac.schemas import TABLES, conform
from tarmac.sources import layout, tables, work


def test_conform_adds_and_casts(spark):
    df = conform(spark.sql("SELECT 1 AS booking_id, 2 AS number_of_passengers, '12.345' AS total_amount, 9 AS extra"), "bookings")
    assert df.columns == [c.split(" ")[0] for c in TABLES["bookings"].split(", ")]
    row = df.first()
    assert (row.booking_id, str(row.total_amount), row.status) == (1, "12.35", None)


def test_a_job_rewrites_the_months_it_has(spark, tmp_path):
    root = str(tmp_path / "air")
    days = ["2001-06-30 23:59", "2001-07-01 00:00", "2001-07-31 10:00", None]
    first = table(spark, "bookings", *[{"booking_id": i, "booking_date": d} for i, d in enumerate(days)])
    layout.write_tables({"bookings": first, "users": table(spark, "users", {"user_id": 1})}, root)
    months = {r.booking_id: r.booking_month for r in layout.read_bookings(spark, root).collect()}
    assert months == {0: "2001-06", 1: "2001-07", 2: "2001-07", 3: None}
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "air/bookings").rglob("*.parquet")}
    layout.write_months(table(spark, "bookings", {"booking_id": 9, "booking_date": "2001-07-02 00:00"}), root)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "air/bookings").rglob("*.parquet")}
    assert {r.booking_id for r in layout.read_bookings(spark, root).collect()} == {0, 3, 9}
    assert {p for p in before if "2001-07" not in str(p)} == {p for p in after if before.get(p) == after[p]}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        layout.write_tables({"users": table(spark, "users", {"user_id": 1})}, root)


def test_bucketed_tables_meet_without_an_exchange(spark, tmp_path):
    bookings = table(spark, "bookings", *[{"booking_id": i, "flight_id": i % 3, "status": "pending"} for i in range(20)])
    people = table(spark, "booking_passengers", *[{"booking_passenger_id": i, "booking_id": i % 20} for i in range(50)])
    saved = [
        layout.save_bucketed(df, name, f"{name}_in_buckets", str(tmp_path / name), 4)
        for name, df in (("bookings", bookings), ("booking_passengers", people))
    ]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = passengers_per_booking(saved[1]).join(saved[0], "booking_id")
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Exchange" not in text
        # seats per flight: the only exchange is of partial sums by flight
        seats = booked_seats(*saved)
        assert seats._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
        assert sorted(map(tuple, seats.collect())) == sorted(map(tuple, booked_seats(bookings, people).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in ("bookings", "booking_passengers"):
            spark.sql(f"DROP TABLE {name}_in_buckets")


def test_month_partitions_are_pruned(spark, tmp_path):
    root = str(tmp_path / "air")
    rows = [{"booking_id": i, "booking_date": f"2001-{1 + i % 12:02d}-15 10:00"} for i in range(48)]
    layout.write_tables({"bookings": table(spark, "bookings", *rows)}, root)
    july = layout.read_bookings(spark, root).where("booking_month = '2001-07'")
    assert len(july.inputFiles()) >= 1 and july.count() == 4
    assert "PartitionFilters: [isnotnull(booking_month" in july._jdf.queryExecution().executedPlan().toString()


def test_reports_prune_months(spark, tmp_path):
    """The same figures with and without month partitions, from fewer files."""
    rows = [
        {"booking_id": i, "booking_date": f"{2000 + i % 2}-{1 + i % 12:02d}-15 10:00", "total_amount": i, "status": "confirmed", "payment_status": "paid"}
        for i in range(96)
    ]
    plain = table(spark, "bookings", *rows)
    layout.write_tables({"bookings": plain}, str(tmp_path))
    stored = layout.read_bookings(spark, str(tmp_path))
    for report, months in [
        (reports.monthly_revenue, 1),
        (reports.monthly_confirmed_bookings, 1),
        (reports.revenue_trend, 7),
        (reports.booking_trend, 7),
        (reports.revenue_growth, 2),
        (reports.booking_growth, 2),
    ]:
        for as_of in ("2001-03-31", "2001-12-01"):
            pruned = report(stored, as_of)
            assert pruned.collect() == report(plain, as_of).collect()
            text = pruned._jdf.queryExecution().executedPlan().toString()
            assert "(booking_month" in text.split("PartitionFilters: ")[1].split("PushedFilters")[0], report


def test_load_tables(spark, tmp_path):
    table(spark, "airports", {"airport_code": "A", "city": "a"}).write.parquet(str(tmp_path / "airports"))
    loaded = tables.load_tables(spark, str(tmp_path), "airports")
    assert [r.city for r in loaded["airports"].collect()] == ["a"]


def test_work_folder_comes_from_the_session(spark):
    assert work.work_dir(spark) == spark.conf.get(work.SETTING)
    assert work.new_folder(spark, "x") != work.new_folder(spark, "x")
    df = work.stored(spark.range(3), "ids")
    assert df.count() == 3 and work.work_dir(spark) in df.inputFiles()[0]


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "yarn", "spark://host:7077"])
def test_several_processes_need_a_shared_folder(master):
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master=master)
    )
    with pytest.raises(ValueError, match=work.SETTING):
        work.work_dir(session)


class Reader:
    """Records what a JDBC read is asked for; there is no database here."""

    def __init__(self, spark, bounds):
        self.spark, self.bounds, self.reads = spark, bounds, []

    @property
    def read(self):
        return self

    def format(self, name):
        assert name == "jdbc"
        return self

    def options(self, **options):
        self.reads.append(options)
        return self

    def load(self):
        if "bounds" in self.reads[-1]["dbtable"]:
            low, high = self.bounds
            return self.spark.sql(f"SELECT CAST({low} AS BIGINT) AS low, CAST({high} AS BIGINT) AS high")
        return self.spark.sql("SELECT 5 AS booking_id, 'A' AS airport_code")


def test_jdbc_reads_ranges_of_the_key(spark):
    reader = Reader(spark, (10, 90))
    df = tables.load_jdbc(reader, "jdbc:mysql://host/db", "bookings", {"user": "u"}, partitions=8)
    assert df.columns == conform(spark.range(0), "bookings").columns
    assert reader.reads[-1] == {
        "user": "u",
        "url": "jdbc:mysql://host/db",
        "fetchsize": "10000",
        "partitionColumn": "booking_id",
        "lowerBound": "10",
        "upperBound": "91",
        "numPartitions": "8",
        "dbtable": "bookings",
    }
    empty = Reader(spark, ("NULL", "NULL"))
    tables.load_jdbc(empty, "url", "bookings", {})
    assert "partitionColumn" not in empty.reads[-1]
    small = Reader(spark, None)
    tables.load_jdbc(small, "url", "airports", {})
    assert len(small.reads) == 1
