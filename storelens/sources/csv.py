"""Order-line CSV export (header row, Latin-1) -> canonical base columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.schema import CSV_COLUMN_NAMES, ORDER_LINE_SCHEMA
from storelens.sources.records import read_records


def read_order_csv(spark: SparkSession, path: str, *, date_format: str = "M/d/yyyy",
                   encoding: str = "ISO-8859-1", row_id_type: str = "long") -> DataFrame:
    """Read the export with every column as text (no inference pass), then cast.

    Records follow RFC 4180: quoted fields may hold commas, doubled quotes and
    line breaks, and a large file is still read split by split
    (:mod:`storelens.sources.records`).

    Dates are parsed with ``to_date(c, date_format)``; under ANSI mode a value
    that does not parse fails the job, like the strict parse of the original
    loader.  ``Row ID`` is the row's position in the file and breaks every tie,
    so it is read as a number (``row_id_type="string"`` for exports whose ids
    are no numbers).  Columns of the file that are not used pass through
    unchanged.
    """
    raw = read_records(spark, path, encoding=encoding)
    types = {f.name: f.dataType for f in ORDER_LINE_SCHEMA.fields}
    types["row_id"] = row_id_type
    out = []
    for src, dst in CSV_COLUMN_NAMES.items():
        c = F.col(f"`{src}`")
        if dst in ("order_date", "ship_date"):
            c = F.to_date(c, date_format)
        else:
            c = c.cast(types[dst])
        out.append(c.alias(dst))
    extra = [F.col(f"`{c}`") for c in raw.columns if c not in CSV_COLUMN_NAMES]
    return raw.select(*out, *extra)
