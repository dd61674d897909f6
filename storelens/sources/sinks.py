"""CSV sinks: the filtered-view export and the small summary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelens.session import fresh_dir

QUOTING = {"quote": '"', "escape": '"'}


def write_csv(df: DataFrame, path: str, *, single_file: bool = False) -> str:
    """Write with a header row, overwriting ``path``; quotes inside a field are doubled (RFC 4180), white space stays.

    Large frames are written as one part file per task (parallel, no funnel
    through one task).  ``single_file`` coalesces to one part and is meant only
    for the bounded summary tables (top-k lists, KPI rows).
    """
    out = df.coalesce(1) if single_file else df
    (out.write.mode("overwrite").option("header", True).options(**QUOTING)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def stored(df: DataFrame, kind: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet under the shared folder (``options`` of the writer) and read back."""
    path = fresh_dir(df.sparkSession, kind)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read a directory written by :func:`write_csv` back with a fixed schema.

    Fields may span lines, so a task reads whole part files; their number is the parallelism.
    """
    return (spark.read.schema(schema).option("header", True).options(**QUOTING).option("multiLine", True)
            .option("mode", "FAILFAST").option("enforceSchema", False).csv(path))


def export_filtered(spark: SparkSession, df: DataFrame, path: str | None = None) -> str:
    """Export a (filtered) order-line view as CSV parts under the shared folder."""
    path = path or fresh_dir(spark, "exports")
    return write_csv(df, path)
