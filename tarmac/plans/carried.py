"""State carried from row to row of a key, however many rows the key has.

What a row does to the state is a function of it, and functions that set a value or leave it compose to functions of the
same kind: the last value set, if any. So the composition over any run of rows is one row of last values, and the state
before a row composes what earlier ranges leave for its key with what its own range does before it.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.sources.work import stored

PART = "_range"


def carried(df: DataFrame, key: str, order: Sequence[str], values: dict[str, str]) -> DataFrame:
    """``df`` with a column for each of ``values``: the last non-null value of the named column over the rows of the same
    ``key`` before this one in ``order``, null if there is none.

    Rows are dealt by range of the key and ``order`` and written once, so a key with many rows, or with many at one instant,
    lies in several ranges, and a window never holds more than a range. A range leaves one row for the key it ends with,
    which the later ranges that begin with the key read. ``order`` must be total within a key; null keys are one key.
    """
    dealt = stored(df.repartitionByRange(key, *order).withColumn(PART, F.spark_partition_id()), "carried")
    place = F.struct(*order)
    inside = Window.partitionBy(PART, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def last(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), place))

    sets = {f"_set{i}": column for i, column in enumerate(values.values())}
    per_key = dealt.groupBy(PART, key).agg(*[last(column).alias(name) for name, column in sets.items()])
    # One row for each range: the key it begins with, the key it ends with, and what it leaves for the latter.
    keys = F.struct(F.col(key).isNotNull().alias("given"), F.col(key).alias("key"))
    ends = per_key.groupBy(PART).agg(
        F.min(keys).alias("first"), F.max(keys).alias("last"), F.max_by(F.struct(*sets), keys).alias("left")
    )
    asks = ends.select(PART, F.col("first").alias("of"), *[F.lit(None).cast(per_key.schema[n].dataType).alias(n) for n in sets])
    gives = ends.select(PART, F.col("last").alias("of"), *[F.col("left")[n].alias(n) for n in sets])
    before = Window.partitionBy("of").orderBy(PART).rangeBetween(Window.unboundedPreceding, -1)
    carry = asks.withColumn("asks", F.lit(True)).unionByName(gives.withColumn("asks", F.lit(False)))
    carry = carry.select(
        PART, F.col("of.key").alias("_of"), "asks", *[F.last(n, ignorenulls=True).over(before).alias(n) for n in sets]
    )
    # As many rows as there are ranges, so as shuffle partitions.
    carry = F.broadcast(carry.where("asks").drop("asks").withColumnRenamed(PART, "_at"))
    rows = dealt.withColumns({name: F.last(c, ignorenulls=True).over(inside) for name, c in values.items()})
    rows = rows.join(carry, (F.col(PART) == F.col("_at")) & F.col(key).eqNullSafe(F.col("_of")), "left")
    rows = rows.withColumns({name: F.coalesce(name, n) for name, n in zip(values, sets, strict=True)})
    return reduce(DataFrame.drop, [PART, "_at", "_of", *sets], rows)
