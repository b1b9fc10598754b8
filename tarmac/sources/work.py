"""The shared folder for intermediate tables and stream progress."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def work_dir(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; a run in one process without one gets a temporary
    folder."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        folder = tempfile.mkdtemp(prefix="tarmac-")
        spark.conf.set(SETTING, folder)
        return folder
    raise ValueError(f"set {SETTING} to a folder that all executors share")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the work folder that no other run uses."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the work folder and read back: cuts the lineage and is computed once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
