"""Every registered query against its oracle."""

import pytest

import __spark_entry__ as contract
import checks
from compare import connect, differences

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# These tell right from wrong only where flights fill up and bookings change often.
NEED_MEDIUM = {"admit_bookings", "booking_changes", "checkin_eligibility", "confirm_checkins"}


@pytest.fixture(scope="module")
def databases():
    return {folder: connect(folder) for folder in (SMALL, MEDIUM)}


@pytest.mark.parametrize("name", list(checks.QUERIES))
def test_query_equals_oracle(spark, databases, name):
    folder = MEDIUM if name in NEED_MEDIUM else SMALL
    df = checks.QUERIES[name](spark, folder)
    assert differences(df, databases[folder], checks.ORACLES[name]) == []


def test_every_query_has_an_oracle():
    assert set(checks.QUERIES) == set(checks.ORACLES)
    assert set(checks.QUERIES) <= set(contract.queries()) and set(checks.ORACLES) <= set(contract.oracle_sql())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_all_check_in_outcomes_occur(spark):
    df = contract.queries()["checkin_eligibility"](spark, MEDIUM)
    assert {r.reasons for r in df.select("reasons").distinct().collect()} == {
        "",
        "invalid_request",
        "booking_not_found",
        "access_denied",
        "not_confirmed",
        "last_name_mismatch",
        "already_checked_in",
        "departed",
        "window_not_open",
    }
