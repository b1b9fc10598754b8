"""Cancellations and status changes of bookings, applied in order of (change_ts, change_id).

Whether a cancellation is accepted depends on what the earlier changes of its booking left behind; everything else is
decided row by row. A change sets the status or, as a cancellation, sets it to cancelled unless it is completed. Any run
of changes composes to the last status set and whether a cancellation came after it, so the state that a change meets is
carried over ranges of (booking, time, id): all changes of one booking, even at one instant, are spread over tasks.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.rules import failures, first_failure
from tarmac.plans.carried import carried
from tarmac.plans.lookup import lookup
from tarmac.plans.outcome import Outcome, is_ok
from tarmac.sources.work import stored

# What each side may set.
USER_SETS = ("completed", "missed", "cancelled")
ADMIN_SETS = ("pending", "confirmed", "cancelled", "completed")
PAYMENT_SETS = ("pending", "paid", "refunded")
CHANGE_COLUMNS = ["change_id", "change_ts", "booking_id", "op", "status", "payment_status"]


def _key() -> Column:
    return F.struct("change_ts", "change_id")


def row_reasons() -> Column:
    """Reasons that need no other change: columns of a change next to owner_id and known of its booking."""
    op, status, payment = F.col("op"), F.col("status"), F.col("payment_status")

    def outside(value: Column, allowed: tuple[str, ...]) -> Column:
        return ~F.coalesce(value.isin(*allowed), F.lit(False))

    user, admin = op == "user_status", op == "admin_status"
    early = failures(
        (~F.coalesce(op.isin("cancel", "user_status", "admin_status"), F.lit(False)), "unknown_op"),
        (user & outside(status, USER_SETS) | admin & outside(status, ADMIN_SETS), "invalid_status"),
        (admin & payment.isNotNull() & outside(payment, PAYMENT_SETS), "invalid_payment_status"),
    )
    foreign = ~F.col("owner_id").eqNullSafe(F.col("requester_id")) & (op != "admin_status")
    late = first_failure((F.col("known").isNull() | foreign, "booking_not_found"))
    return F.when(F.size(early) > 0, early).otherwise(late)


def current_state(bookings: DataFrame) -> DataFrame:
    """The owner and the state of every booking, for a change to be joined to."""
    return bookings.select(
        "booking_id",
        F.lit(True).alias("known"),
        F.col("user_id").alias("owner_id"),
        F.col("status").alias("base_status"),
        F.col("payment_status").alias("base_payment"),
    )


def refusal(status_before: Column) -> Column:
    """Reason to refuse a cancellation of a booking in ``status_before``, null if it is accepted."""
    return F.when(status_before == "cancelled", "already_cancelled").when(status_before == "completed", "already_completed")


def _status_before(valid: DataFrame) -> DataFrame:
    """The booking status every valid change meets."""
    is_cancel = F.col("op") == "cancel"
    valid = valid.withColumns({"is_cancel": is_cancel, "written": F.when(~is_cancel, F.col("status"))})
    met = carried(
        valid, "booking_id", ["change_ts", "change_id"], {"set_before": "written", "cancel_before": "is_cancel"}
    )
    set_to = F.coalesce("set_before", "base_status")
    cancelled = F.when(set_to == "completed", set_to).otherwise(F.lit("cancelled"))
    after_cancel = F.coalesce("cancel_before", F.lit(False))
    return met.withColumn("status_before", F.when(after_cancel, cancelled).otherwise(set_to))


def decided_on(found: DataFrame) -> DataFrame:
    """Changes next to ``current_state`` of their bookings, with the reasons to refuse them.

    The changes with what can be said row by row are stored first; two steps read them.
    """
    columns = [*CHANGE_COLUMNS, "reasons"]
    checked = stored(found.withColumn("reasons", row_reasons()).select(*columns, "base_status"), "checked-changes")
    refused = F.when(F.col("op") == "cancel", refusal(F.col("status_before")))
    met = _status_before(checked.where(is_ok())).withColumn("reasons", F.array_compact(F.array(refused)))
    return checked.where(~is_ok()).select(columns).unionByName(met.select(columns))


def decide_changes(bookings: DataFrame, changes: DataFrame) -> Outcome:
    """Decide ``changes`` (change_id, change_ts, booking_id, requester_id, op, status, payment_status).

    op is ``cancel`` (owner; not if cancelled or completed), ``user_status`` (owner) or ``admin_status`` (any booking,
    with an optional payment status).
    """
    decided = decided_on(lookup(changes, current_state(bookings), ["booking_id"], "change_id"))
    return Outcome(decided, "change_id", CHANGE_COLUMNS[1:])


def left_behind(accepted: DataFrame) -> DataFrame:
    """(booking_id, new_status, new_payment, changed_at): what the accepted changes of each booking compose to.

    ``new_payment`` is null where they leave the payment as it was.
    """
    is_cancel = F.col("op") == "cancel"
    payment = F.when(is_cancel, F.lit("refunded")).when(F.col("op") == "admin_status", F.col("payment_status"))
    return accepted.groupBy("booking_id").agg(
        F.max_by(F.when(is_cancel, F.lit("cancelled")).otherwise(F.col("status")), _key()).alias("new_status"),
        F.max_by(payment, F.when(payment.isNotNull(), _key())).alias("new_payment"),
        F.max("change_ts").alias("changed_at"),
    )


def apply_changes(bookings: DataFrame, accepted: DataFrame) -> DataFrame:
    """The bookings table after the accepted changes."""
    values = {
        "status": F.coalesce("new_status", "status"),
        "payment_status": F.coalesce("new_payment", "payment_status"),
        "updated_at": F.coalesce("changed_at", "updated_at"),
    }
    return bookings.join(left_behind(accepted), "booking_id", "left").withColumns(values).select(bookings.columns)
