"""Seat admission over an arriving stream of requests; the seats a flight has given away are the state.

Order is arrival order: micro-batch by micro-batch, and by (request_ts, request_id) within one. As in the batch job,
the queue is cut before the requests of a flight meet. That takes two streams linked by a table: the first spreads
each flight over ``SPREAD`` parts, and a part passes on no more requests of a size than the flight could ever seat;
the second seats what was passed on.

Only whole numbers go through Python: times as microseconds, and a request's other columns join its decision later.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarmac.operators.admission import priced, with_defaults
from tarmac.plans.lookup import lookup
from tarmac.plans.outcome import is_ok
from tarmac.sources.work import new_folder
from tarmac.streaming.run import run_available

SPREAD = 16
DECISION = "request_id BIGINT, flight_id BIGINT, n_seats BIGINT, reason STRING"
QUEUE = "arrived BIGINT, asked BIGINT, request_id BIGINT, flight_id BIGINT, n_seats BIGINT, free BIGINT, queued BOOLEAN"
DECISION_COLUMNS = [c.split(" ")[0] for c in DECISION.split(", ")]
QUEUE_COLUMNS = [c.split(" ")[0] for c in QUEUE.split(", ")]
NO_SEATS = "not_enough_seats"


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.iloc[np.lexsort([rows[c].to_numpy() for c in ("request_id", "asked", "arrived")])]


def cut_queue(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Queue the first ``free // n`` requests for n seats and no others.

    The state is how many of each size have been queued. Only those that may be are held in memory.
    """
    before = dict(zip(*state.get, strict=True)) if state.exists else {}
    passed, waiting = before, None
    for batch in batches:
        rows = _in_order(batch if waiting is None else pd.concat([waiting, batch]))
        free, passed, fits = int(rows["free"].iloc[0]), dict(before), []
        for n in rows["n_seats"].tolist():
            count = passed.get(n, 0) + 1
            fits.append(count * n <= free)
            if fits[-1]:
                passed[n] = count
        fits = np.array(fits)
        if not fits.all():
            yield rows.loc[~fits, QUEUE_COLUMNS]
        waiting = rows[fits]
    if waiting is not None and len(waiting):
        state.update((list(passed), list(passed.values())))
        yield waiting[QUEUE_COLUMNS].assign(queued=True)


def seat_queue(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Seat the queue of a flight in order. The cut bounds the queue by the seats of the flight."""
    rows = _in_order(pd.concat(list(batches)))
    free, used = int(rows["free"].iloc[0]), state.get[0] if state.exists else 0
    reasons = []
    for n in rows["n_seats"].tolist():
        fits = n <= free - used
        reasons.append("" if fits else NO_SEATS)
        used += n if fits else 0
    state.update((used,))
    yield rows.assign(reason=reasons)[DECISION_COLUMNS]


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def queue_stream(requests: DataFrame, free: DataFrame) -> DataFrame:
    """First stream: requests with the reason to refuse them, or queued.

    ``free`` are the free seats of the open flights when the stream began. It is read again for every micro-batch and
    must not change meanwhile: store it first.
    """
    asked = priced(with_defaults(requests).join(free, "flight_id", "left")).select(
        _micros(F.current_timestamp()).alias("arrived"),
        _micros(F.col("request_ts")).alias("asked"),
        "request_id",
        "flight_id",
        "n_seats",
        F.col("free").cast("bigint").alias("free"),
        F.lit(False).alias("queued"),
        F.when(is_ok(), F.lit("")).otherwise(F.get("reasons", F.lit(0))).alias("reason"),
        F.pmod(F.xxhash64("request_id"), F.lit(SPREAD)).alias("part"),
    )
    cut = (
        asked.where(F.col("reason") == "")
        .drop("reason")
        .groupBy("flight_id", "part")
        .applyInPandasWithState(
            cut_queue, QUEUE, "sizes ARRAY<BIGINT>, counts ARRAY<BIGINT>", "append", GroupStateTimeout.NoTimeout
        )
    )
    refused = asked.where(F.col("reason") != "").select(*QUEUE_COLUMNS, "reason")
    return refused.unionByName(cut.withColumn("reason", F.when(~F.col("queued"), F.lit(NO_SEATS))))


def seat_stream(queue: DataFrame) -> DataFrame:
    """Second stream: decisions on the queued requests; an empty reason is an acceptance."""
    return (
        queue.where("queued")
        .select(QUEUE_COLUMNS)
        .groupBy("flight_id")
        .applyInPandasWithState(seat_queue, DECISION, "used BIGINT", "append", GroupStateTimeout.NoTimeout)
    )


def admit_available(requests: DataFrame, free: DataFrame, folder: str | None = None) -> DataFrame:
    """Run both streams over what has arrived and return every decision so far; the same folder goes on from there."""
    spark = requests.sparkSession
    folder = folder or new_folder(spark, "admissions")
    queue = run_available(queue_stream(requests, free), "queue", f"{folder}/queue")
    arriving = spark.readStream.schema(queue.schema).parquet(f"{folder}/queue/data")
    seated = run_available(seat_stream(arriving), "seated", f"{folder}/seated")
    return queue.where(~F.col("queued")).select(DECISION_COLUMNS).unionByName(seated)


def accepted_requests(decisions: DataFrame, requests: DataFrame, free: DataFrame) -> DataFrame:
    """Accepted requests with all of their columns and the total amount, as the batch job gives them."""
    ids = decisions.where(F.col("reason") == "").select("request_id")
    accepted = with_defaults(requests.join(ids, "request_id", "left_semi"))
    return priced(lookup(accepted, free, ["flight_id"], "request_id"))
