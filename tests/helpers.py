import glob
import os


def values(spark, expression, **columns):
    """The value of an expression over one row of the given columns."""
    from pyspark.sql import functions as F

    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.lit(v).cast("array<string>").alias(k) for k, v in columns.items()])
    return row.select(expression.alias("v")).first()["v"]


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def normal(frame):
    import pandas as pd

    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(lambda v: "NULL" if v is None or v is pd.NaT or v != v else f"{float(v):.6g}" if isinstance(v, float) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)
