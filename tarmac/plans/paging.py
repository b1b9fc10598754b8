"""A page far into a sorted table, without bringing everything before it to one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID_BLOCK = 100_000


def page(df: DataFrame, order: list[Column], buckets: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of ``df`` in ``order``, which must be total; found by counting."""
    return deep_page(df, order, buckets, offset, limit).orderBy(*order)


def deep_page(df: DataFrame, order: list[Column], buckets: list[Column], offset: int, limit: int) -> DataFrame:
    """As ``page``, by counting.

    ``buckets`` are ever finer parts of the order as non-null integers, ascending in it. Each step counts the rows per
    bucket and keeps the buckets the page touches, at most ``limit`` of them as none is empty; rows are numbered
    within the last bucket only.
    """
    columns, levels = df.columns, [f"_level{i}" for i in range(len(buckets))]
    rows = df.withColumns(dict(zip(levels, buckets, strict=True))).withColumn("_before", F.lit(0).cast("bigint"))
    for depth, level in enumerate(levels):
        parents = levels[:depth]
        earlier = Window.partitionBy(*parents).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        counted = rows.groupBy(*parents, level, "_before").agg(F.count("*").alias("_rows"))
        start = F.col("_before") + F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
        touched = (
            counted.withColumn("_start", start)
            .where((F.col("_start") < offset + limit) & (F.col("_start") + F.col("_rows") > offset))
            .select(*parents, level, F.col("_start").alias("_before"))
        )
        rows = rows.drop("_before").join(F.broadcast(touched), [*parents, level])
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*levels).orderBy(*order))
    numbered = rows.withColumn("_place", place)
    return numbered.where((F.col("_place") > offset) & (F.col("_place") <= offset + limit)).select(columns)


def latest_first(ts: str) -> list[Column]:
    """Buckets of a descending timestamp, nulls last: day, second of the day, microsecond."""
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    micros = (F.date_part(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("int") % 1_000_000
    return [
        F.coalesce(-F.unix_date(F.to_date(ts)), F.lit(2**31 - 1)),
        F.coalesce(-second, F.lit(0)),
        F.coalesce(-micros, F.lit(0)),
    ]


def id_block(key: str) -> Column:
    """Bucket of a unique ascending id; it holds at most ``ID_BLOCK`` rows."""
    return F.floor(F.col(key) / ID_BLOCK)
