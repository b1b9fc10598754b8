"""Texts compared by a collation, such as ``UNICODE_CI_AI``: letters that differ in case and accents alone are equal.

Without a collation texts are compared byte by byte. Spark groups, joins and hashes collated texts by their collation key.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORE_CASE_AND_ACCENTS = "UNICODE_CI_AI"


def compared(value: Column, collation: str | None) -> Column:
    """``value`` as a key of groups and joins."""
    return value if collation is None else F.collate(value, collation)


def lower_or_compared(value: Column, collation: str | None) -> Column:
    """A key that ignores case: lower-cased without a collation, left to the collation otherwise."""
    return F.lower(value) if collation is None else F.collate(value, collation)


def one_spelling(df: DataFrame, column: str, collation: str) -> DataFrame:
    """``df`` with each text of ``column`` in the first, byte by byte, of the spellings that the collation holds equal.

    The spellings are reduced map-side to one row for each text, so a text that most rows share arrives once. Null stays.
    """
    first = df.groupBy(compared(F.col(column), collation).alias("_compared")).agg(F.min(column).alias("_spelling"))
    spelled = df.withColumn("_compared", compared(F.col(column), collation)).join(first, "_compared", "left")
    return spelled.withColumn(column, F.col("_spelling")).select(df.columns)
