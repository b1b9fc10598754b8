"""Run a stream over what has arrived and hand back what it wrote."""

from pyspark.sql import DataFrame

from tarmac.sources.work import new_folder


def run_available(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Process all available input of an append stream and return everything it has written to ``folder`` so far.

    Progress and state live next to the output; a later call with the same folder goes on from there.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/data")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")
