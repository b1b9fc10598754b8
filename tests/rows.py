"""Small tables for golden tests: rows as dictionaries, everything else null."""

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarmac.schemas import TABLES


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def frame(spark: SparkSession, ddl: str, rows: list[dict]) -> DataFrame:
    schema = T.StructType.fromDDL(ddl)

    def value(field: T.StructField, x):
        if isinstance(field.dataType, T.DecimalType) and x is not None:
            return Decimal(str(x))
        if isinstance(field.dataType, T.TimestampNTZType) and isinstance(x, str):
            return ts(x)
        if isinstance(field.dataType, T.DateType) and isinstance(x, str):
            return date.fromisoformat(x)
        return x

    return spark.createDataFrame([[value(f, r.get(f.name)) for f in schema.fields] for r in rows], schema)


def table(spark: SparkSession, name: str, *rows: dict) -> DataFrame:
    return frame(spark, TABLES[name], list(rows))


def one(df: DataFrame) -> dict:
    (row,) = df.collect()
    return row.asDict(recursive=True)


def reasons(decided: DataFrame, key: str = "request_id") -> dict:
    return {r[key]: list(r["reasons"]) for r in decided.select(key, "reasons").collect()}
