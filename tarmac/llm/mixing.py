"""Operator 10: mix sources to target weights by cutting each source, in hash-random order, at its exact budget."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.plans.running import running
from tarmac.sources.work import stored

WEIGHTS = (1, 2, 3)
EPOCHS = 3
# Up to so many sources their table is broadcast (a few hundred bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
# Ranges of the random key for each shuffle partition: enough to even out, few enough to sum in one task.
RANGES = 8


def hash_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A random but repeatable place of a document: MD5 of its id and text, as hexadecimal digits."""
    return F.md5(
        F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(" "), F.coalesce(text, F.lit("")))
    )


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``sources`` (src, words) with ``weight`` and ``target`` words.

    Sources take the weights in turn, by code point of their name, null last, and share all words by weight. A target
    stops at ``epochs`` times its source; the excess goes to the others by weight until none is above. In the order of
    words per weight the capped sources come first, so sums over the rows before tell which they are.
    """
    ranked = running(
        sources.withColumn("__one", F.lit(1)), [F.col("src").isNull().asc(), F.col("src").asc()], {"place": "__one"}
    )
    choice = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(choice, (F.col("place") % len(weights) + 1).cast("int")))
    ranked = stored(ranked.withColumn("cap", F.col("words") * epochs), "weights")
    all_words, all_weight = ranked.agg(F.sum("words"), F.sum("weight")).first()
    by_ratio = [(F.col("cap") / F.col("weight")).asc(), F.col("place").asc()]
    filled = running(
        ranked.withColumns({"__cap": F.col("cap"), "__weight": F.col("weight")}),
        by_ratio,
        {"cap_before": "__cap", "weight_before": "__weight"},
    )
    left = F.lit(all_words or 0) - F.col("cap_before")
    capped = F.col("cap") * (F.lit(all_weight or 0) - F.col("weight_before")) < left * F.col("weight")
    filled = stored(filled.withColumn("capped", capped), "filled")
    full = filled.where("capped").agg(F.sum("cap"), F.sum("weight")).first()
    rest, shared = (all_words or 0) - (full[0] or 0), (all_weight or 0) - (full[1] or 0)
    # As a long: a rest of fewer than 2^31 words is an int literal, whose product with a weight can pass that.
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        F.lit(rest).cast("long") * F.col("weight") / F.lit(float(max(shared, 1)))
    )
    return filled.select("src", "words", "weight", target.alias("target"))


def mix(
    docs: DataFrame,
    size: str = "size",
    source: str = "source",
    key: str = "key",
    weights: Sequence[int] = WEIGHTS,
    epochs: int = EPOCHS,
) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` (of the row's source) and ``taken`` (words of the row in the mix).

    Within a source, rows lie in the order of ``key``. A source whose target is e times its size and a rest gives every
    row e times, and once more the rows from the start until the rest is reached; the row at the cut gives a part. So
    the taken words of a source are its target rounded down, and no row gives more than ``epochs`` times its size.

    ``size`` must be a non-negative number, null counts as 0; a null source is a source; ``key`` must not be null. Rows
    with equal keys lie in any order: rows that are the same in all columns are as good as each other. An empty table
    gives an empty result. Input columns named like an output column are replaced.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source).alias("src"),
        F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"),
        F.col(key).alias("key"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("sk"),
    )
    per = stored(rows.groupBy("src").agg(F.count("*").alias("rows"), F.sum("size").alias("words")), "sources")
    n_sources, n_rows = per.agg(F.count("*"), F.sum("rows")).first()
    cuts = source_targets(per.select("src", "words"), weights, epochs)
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = per.select(
        F.coalesce(F.concat(F.lit("s"), F.col("src")), F.lit("n")).alias("sk"),
        F.ceil(F.col("rows") * ranges / F.lit(max(n_rows or 0, 1))).alias("ranges"),
    )
    budget = F.floor("target").cast("long")
    cuts = cuts.select(
        F.coalesce(F.concat(F.lit("s"), F.col("src")), F.lit("n")).alias("sk"),
        F.col("words").alias("source_size"),
        "target",
        F.when(F.col("words") > 0, F.floor(budget / F.col("words"))).otherwise(0).cast("long").alias("whole"),
        F.when(F.col("words") > 0, budget % F.col("words")).otherwise(0).cast("long").alias("rest"),
    )
    plan = stored(cuts.join(counts, "sk"), "cuts")
    # The key's first 13 digits as a fraction of their range: equal shares of the rows, in the order of the key.
    share = F.conv(F.substring("key", 1, 13), 16, 10).cast("double") / float(16**13)
    dealt = rows.join(F.broadcast(plan) if n_sources <= BROADCAST_SOURCES else plan, "sk").withColumn(
        "range", F.floor(share * F.col("ranges"))
    )
    earlier = Window.partitionBy("sk").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("sk", "range")
        .agg(F.sum("size").alias("__sum"))
        .select("sk", "range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("sk", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, ["sk", "range"]
    )
    extra = F.least("size", F.greatest(F.lit(0), F.col("rest") - F.col("offset") - F.col("inside")))
    out = {
        "source_size": F.col("source_size"),
        "target": F.col("target"),
        "taken": F.col("whole") * F.col("size") + extra,
    }
    return placed.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in out], *[v.alias(k) for k, v in out.items()]
    )
