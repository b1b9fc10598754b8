"""From documents to packed training sequences: five stages, each on all that the one before has kept.

1. quality rules: documents that the rules or the perplexity band reject go.
2. line dedup: lines that match an earlier line go.
3. near duplicates: one document of each group stays.
4. mixing: documents go, stay or repeat, so that each source comes near its target; the document at a source's cut stays
   if at least half of it is within the budget.
5. packing: the documents' pieces get their places in sequences of several lengths.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import line_dedup, mixing, near_dups, packing, quality
from tarmac.llm.text import word_count
from tarmac.sources.work import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.first_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents: as often as the mix takes them, a part of at least a half counting as a whole.

    Documents without words have nothing to take and go.
    """
    columns = [f"`{c}`" for c in docs.columns]
    rows = docs.select(
        F.struct(*columns).alias("document"),
        "source",
        word_count(F.col("text")).alias("size"),
        mixing.hash_key().alias("key"),
    )
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    mixed = mixing.mix(rows).withColumn("times", times).where("times > 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.col("times")))
    return mixed.select("document", copies.alias("copy")).select("document.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", word_count(F.col("text")).alias("size")))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", unique_lines),
    ("n-gram jaccard join", near_duplicates),
    ("source mixing", source_mix),
    ("best-fit packing", packed),
]

# Hash sets, a fitted model and a packing are beyond SQL; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents table; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
