"""Tables of fixed length that every task can hold, whatever the size of the data they summarise."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.sources.work import stored

BLOCK = 4096


def fixed_table(codes: DataFrame, bits: int, kind: str = "byte") -> DataFrame:
    """One row with ``codes``: an array of 2^``bits`` values of ``kind``, with ``code`` at each ``bucket`` of the input, else 0.

    ``codes`` has at most one row for each bucket.
    """
    zeros = codes.sparkSession.range(2**bits).select(F.col("id").alias("bucket"), F.lit(0).cast(kind).alias("code"))
    dense = codes.select("bucket", F.col("code").cast(kind).alias("code")).unionByName(zeros)
    dense = dense.groupBy("bucket").agg(F.bit_or("code").alias("code"))
    blocks = dense.groupBy(F.floor(F.col("bucket") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("bucket", "code"))).alias("part")
    )
    blocks = blocks.select("block", F.transform("part", lambda x: x["code"]).alias("part"))
    whole = blocks.agg(F.sort_array(F.collect_list(F.struct("block", "part"))).alias("parts"))
    return stored(whole.select(F.flatten(F.transform("parts", lambda x: x["part"])).alias("codes")), "table")


def place(hashed: Column, bits: int) -> Column:
    """A hash's bucket."""
    return hashed.bitwiseAND(F.lit(2**bits - 1))


def look_up(codes: Column, hashed: Column, bits: int) -> Column:
    """The code in the table at a hash's bucket."""
    return F.get(codes, place(hashed, bits).cast("int"))
