"""All pages of a listing at once: the bounds of every page, and a page as a range of keys.

The listing is ordered by descending time, nulls last, then by ascending id, which is unique.
"""

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tarmac.plans.running import running


def latest_first(ts: str, key: str) -> list[Column]:
    return [F.desc_nulls_last(ts), F.asc(key)]


def directory(df: DataFrame, ts: str, key: str, limit: int) -> DataFrame:
    """(page, row_count, first_ts, first_key, last_ts, last_key) of every page of ``limit`` rows, from 1.

    Only the two columns are dealt, once, by range; a page is reduced map-side from at most a few ranges.
    """
    places = running(df.select(ts, key, F.lit(1).alias("place")), latest_first(ts, key), {"place": "place"})
    bounds = F.struct(F.col(ts).alias("ts"), F.col(key).alias("key"))
    pages = places.groupBy((F.floor(F.col("place") / limit) + 1).alias("page")).agg(
        F.count("*").alias("row_count"),
        F.min_by(bounds, "place").alias("first"),
        F.max_by(bounds, "place").alias("last"),
    )
    ends = [F.col(end)[part].alias(f"{end}_{part}") for end in ("first", "last") for part in ("ts", "key")]
    return pages.select("page", "row_count", *ends)


def in_page(bounds: Row, ts: str, key: str) -> Column:
    """Whether a row lies within ``bounds``, a row of the directory; comparisons with literals, so they reach the scan."""
    at, number = F.col(ts), F.col(key)

    def same(end) -> Column:
        return at.isNull() if end is None else at == F.lit(end).cast("timestamp_ntz")

    from_first = ~same(bounds.first_ts) | (number >= bounds.first_key)
    to_last = ~same(bounds.last_ts) | (number <= bounds.last_key)
    if bounds.first_ts is None:
        return at.isNull() & (number >= bounds.first_key) & (number <= bounds.last_key)
    latest = at <= F.lit(bounds.first_ts).cast("timestamp_ntz")
    if bounds.last_ts is None:
        return (latest | at.isNull()) & F.coalesce(from_first, F.lit(True)) & to_last
    return latest & (at >= F.lit(bounds.last_ts).cast("timestamp_ntz")) & from_first & to_last
