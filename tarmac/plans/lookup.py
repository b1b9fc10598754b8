"""Looking up one row per key for every row of a feed, where a few keys may hold much of the feed."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.plans.combine import asked_for

# A key with more than this share of the rows is spread over parts of that many rows. Fewer keys than its inverse can be
# so large. Parts of fewer rows than the second number would not be worth their place.
HOT_SHARE = 1 / 10_000
LEAST_ROWS = 100_000
NULL_PARTS = 1024


def lookup(
    feed: DataFrame, base: DataFrame, on: list[str], row_id: str, counted: DataFrame | None = None
) -> DataFrame:
    """``feed`` left joined to ``base``, which has at most one row per key ``on``.

    ``counted`` is a frame with the keys of ``feed`` that takes less to compute, where there is one.

    Keys are counted first, map-side, which also tells which rows of ``base`` are needed. Rows of a hot key go to as
    many partitions as its count asks for, and its row of ``base`` is repeated for each of them. The list of hot keys
    is complete and broadcast: fewer than 1 / ``HOT_SHARE`` keys can each have more than that share of all rows. Rows without a key match nothing and are spread as well.
    """
    counts = (counted or feed).groupBy(*on).agg(F.count("*").alias("_rows"))
    rows_of_part = F.greatest(F.lit(float(LEAST_ROWS)), counts.agg(F.sum("_rows") * F.lit(HOT_SHARE)).scalar())
    hot = counts.withColumn("_limit", rows_of_part).where(F.col("_rows") > F.col("_limit"))
    hot = hot.select(*on, F.ceil(F.col("_rows") / F.col("_limit")).cast("int").alias("_parts"))
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    spread = F.xxhash64(row_id)
    part = (
        F.when(any_null, -1 - F.pmod(spread, F.lit(NULL_PARTS)))
        .when(F.col("_parts").isNotNull(), F.pmod(spread, F.col("_parts")))
        .otherwise(F.lit(0))
        .cast("int")
    )
    rows = feed.join(F.broadcast(hot), on, "left").withColumn("_part", part).drop("_parts")
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    found = asked_for(base, counts, on).join(F.broadcast(hot), on, "left")
    found = found.withColumn("_part", F.explode(parts)).drop("_parts")
    return rows.join(found, [*on, "_part"], "left").drop("_part")
