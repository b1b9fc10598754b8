"""Column expressions on words: runs of characters other than the six ASCII white-space characters."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of ``text`` in order; none for null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE)
    )


def word_count(text: Column) -> Column:
    """The number of words of ``text``; 0 for null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", 0).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")
