"""Requests in, accepted and rejected rows out."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.collation import compared
from tarmac.plans.combine import asked_for
from tarmac.sources.work import stored


def is_ok() -> Column:
    return F.size("reasons") == 0


@dataclass(frozen=True)
class Outcome:
    """Every request with its ``reasons``; those without any are accepted.

    ``decided`` is one plan. ``stored`` computes it once, for whoever uses more than one part of it.
    """

    decided: DataFrame
    key: str
    columns: list[str]

    def stored(self, name: str) -> "Outcome":
        return Outcome(stored(self.decided, name), self.key, self.columns)

    @property
    def accepted(self) -> DataFrame:
        return self.decided.where(is_ok()).select(self.key, *self.columns)

    @property
    def rejected(self) -> DataFrame:
        return self.decided.where(~is_ok()).select(self.key, "reasons")

    @property
    def summary(self) -> DataFrame:
        """All requests: the columns of the accepted ones, null for the others, and the reasons as one text."""
        kept = [F.when(is_ok(), F.col(c)).alias(c) for c in self.columns]
        return self.decided.select(self.key, *kept, F.array_join("reasons", "; ").alias("reasons"))


def reject_taken(
    checked: DataFrame,
    value: str,
    base: DataFrame,
    reason: str,
    key: str = "request_id",
    order: tuple[str, ...] = (),
    collation: str | None = None,
) -> DataFrame:
    """Add ``reason`` to valid requests whose ``value`` is in ``base`` or was asked for by an earlier valid request.

    Values are compared by ``collation``, byte by byte without one.

    The earliest request per value is a minimum, combined map-side, and comes back by the unique ``key``: a value that
    many requests ask for is never gathered.
    """
    earliest = F.min(F.struct(*order, key)).alias("_earliest")
    claim = compared(F.col(value), collation).alias("_claim")
    first = checked.where(is_ok()).groupBy(claim).agg(earliest)
    taken = asked_for(base.select(claim), first, "_claim")
    free = first.join(taken, "_claim", "left_anti").select(
        F.col("_earliest")[key].alias(key), F.lit(True).alias("_free")
    )
    refused = is_ok() & F.col("_free").isNull()
    return (
        checked.join(free, key, "left")
        .withColumn("reasons", F.when(refused, F.array(F.lit(reason))).otherwise(F.col("reasons")))
        .drop("_free")
    )
