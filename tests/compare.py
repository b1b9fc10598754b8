"""Run registered queries against their oracle SQL: ``python tests/compare.py SF_DIR [NAME ...]``."""

import re
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


# DuckDB type to Spark type, where the names differ
TYPES = {
    "varchar": "string",
    "integer": "int",
    "timestamp": "timestamp_ntz",
}


def differences(df, db, sql: str) -> list[str]:
    """What differs between a Spark result and the oracle's: columns, types, row counts, rows."""
    found = []
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    rows = result.fetchall()
    types = {r[0]: r[1].lower() for r in db.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    for name, spark_type in df.dtypes:
        oracle_type = TYPES.get(types[name], types[name])
        if re.sub(r"\s", "", oracle_type) != spark_type:
            found.append(f"type of {name}: {spark_type} vs {oracle_type}")
    order = sorted(names)
    mine = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
    theirs = sorted(repr(tuple(r[names.index(c)] for c in order)) for r in rows)
    if len(mine) != len(theirs):
        found.append(f"{len(mine)} rows vs {len(theirs)}")
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        found.append(f"columns {order}")
        found += [f"only Spark: {x}" for x in sorted(a)[:4]] + [f"only oracle: {x}" for x in sorted(b)[:4]]
    return found


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    db, bad = connect(sf_dir), 0
    for name, query in contract.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        sql = contract.oracle_sql().get(name)
        try:
            df = query(spark, sf_dir)
            problems = differences(df, db, sql) if sql else []
            note = f"{df.count()} rows, no oracle" if not sql else "ok"
        except Exception as e:  # report and go on
            problems, note = [f"{type(e).__name__}: {str(e)[:700]}"], ""
        bad += bool(problems)
        print(f"{name}: {'FAIL' if problems else note} {time.time() - start:.1f}s", *problems, sep="\n    ", flush=True)
    print("failed:", bad)
