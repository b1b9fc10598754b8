"""Booking changes as a stream; what the accepted changes of each booking have left so far is the state.

Order is arrival order: micro-batch by micro-batch, and by (change_ts, change_id) within one. A micro-batch is decided as
the batch job decides a feed, against the bookings as the earlier micro-batches left them, so the changes of one booking
in a micro-batch are spread over tasks however many they are, and what they do is composed map-side to one row.

A micro-batch writes its decisions and the new state, one row for each booking changed so far, to folders of its own
number. One that is run again after a failure writes the same folders again and reads the state of the one before.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators.booking_changes import current_state, decided_on, left_behind
from tarmac.plans.lookup import lookup
from tarmac.sources.work import new_folder

DECISION = (
    "change_id BIGINT, change_ts TIMESTAMP_NTZ, booking_id BIGINT, op STRING, status STRING, payment_status STRING, "
    "reason STRING"
)
STATE = "booking_id BIGINT, new_status STRING, new_payment STRING"


def _state(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """The state that the micro-batch meets."""
    if batch_id == 0:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{folder}/state/batch={batch_id - 1}")


def decide_batch(bookings: DataFrame, folder: str) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` does with the changes of a micro-batch."""

    def run(changes: DataFrame, batch_id: int) -> None:
        spark = changes.sparkSession
        state = _state(spark, folder, batch_id)
        found = lookup(changes, current_state(bookings), ["booking_id"], "change_id")
        found = lookup(found, state, ["booking_id"], "change_id", counted=changes)
        found = found.withColumn("base_status", F.coalesce("new_status", "base_status"))
        path = f"{folder}/data/batch={batch_id}"
        decided_on(found).withColumn("reason", F.array_join("reasons", "; ")).drop("reasons").write.mode(
            "overwrite"
        ).parquet(path)
        accepted = spark.read.schema(DECISION).parquet(path).where(F.col("reason") == "")
        new = left_behind(accepted).withColumnsRenamed({"new_status": "status", "new_payment": "payment"})
        merged = state.join(new.drop("changed_at"), "booking_id", "full").select(
            "booking_id",
            F.coalesce("status", "new_status").alias("new_status"),
            F.coalesce("payment", "new_payment").alias("new_payment"),
        )
        merged.write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")

    return run


def change_available(changes: DataFrame, bookings: DataFrame, folder: str | None = None) -> DataFrame:
    """Decide what has arrived in ``changes`` against ``bookings``, the table when the stream began; all decisions so far.

    A later call with the same folder goes on from there. A decision is accepted if its reason is empty; the accepted ones
    go into ``apply_changes`` as in the batch job.
    """
    spark = changes.sparkSession
    folder = folder or new_folder(spark, "booking-changes")
    query = (
        changes.writeStream.foreachBatch(decide_batch(bookings, folder))
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(DECISION).parquet(f"{folder}/data/*")
