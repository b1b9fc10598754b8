"""Sums over all rows before a row in a total order, without bringing the rows into one task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.sources.work import stored

PART = "__part"


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with a column for each of ``sums``: the sum of the named column over the rows before this one.

    Rows are dealt by range of ``order`` and written once, so that every later reading sees the same ranges. A window
    sums inside a range; the totals of the ranges, one row each, are summed in turn. Rows that tie on the whole of
    ``order`` follow each other in any order. An empty frame stays empty.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), "dealt")
    inside = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(PART).agg(*[F.sum(c).alias(f"__total_{name}") for name, c in sums.items()])
    offsets = totals.select(
        PART, *[F.coalesce(F.sum(f"__total_{name}").over(ranges), F.lit(0)).alias(f"__before_{name}") for name in sums]
    )
    # One row for each range: as many as there are shuffle partitions.
    rows = dealt.withColumns({f"__in_{name}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()})
    rows = rows.join(F.broadcast(offsets), PART)
    return rows.select(
        *[F.col(c) for c in df.columns if c not in sums],
        *[(F.col(f"__before_{name}") + F.col(f"__in_{name}")).alias(name) for name in sums],
    )
