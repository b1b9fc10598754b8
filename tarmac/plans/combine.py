"""Plan-shaping helpers used by more than one operator."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asked_for(base: DataFrame, requests: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``base`` whose key a batch of requests has.

    A small batch is broadcast here, and a large table behind it does not move. The keys are made distinct map-side,
    so one that many requests share arrives once.
    """
    return base.join(requests.select(key).distinct(), key, "left_semi")


def one_row(*frames: DataFrame) -> DataFrame:
    """Side-by-side columns of several one-row frames, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def as_array(df: DataFrame, order: list[Column], fields: list[str], name: str) -> DataFrame:
    """One row holding ``df`` as an array of structs, sorted. For frames of a fixed few rows, such as a top-k."""
    keys = [o.alias(f"_k{i}") for i, o in enumerate(order)]
    item = F.struct(*keys, F.struct(*fields).alias("item"))
    return df.agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]).alias(name))
