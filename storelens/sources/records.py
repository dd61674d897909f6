"""RFC 4180 records from splittable text files.

A quoted field may hold the delimiter, doubled quotes and line breaks.  Spark's ``multiLine`` reader copes with them by
giving a whole file to one task; here large files are read split by split:

1. one aggregation counts the quotes of every split; the running parity tells whether a split begins inside quotes;
2. each split joins its lines into records, in the order of the file.  A record that begins in one split and ends in
   another leaves fragments (at most two a split), which are put together by file;
3. ``from_csv`` parses the records.

Lines end in LF or CR LF.  UTF-8, ISO-8859-1 and ASCII are read this way; files of other encodings, in which a byte
does not tell a quote, go to one task each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
CSV_OPTIONS = {"quote": QUOTE, "escape": QUOTE, "mode": "FAILFAST"}
SPLIT_ENCODINGS = ("UTF-8", "ISO-8859-1", "US-ASCII")
FRAGMENT = "file string, start long, part int, record binary"


def join_lines(batches: Iterator[pa.RecordBatch], header: bool) -> Iterator[pa.RecordBatch]:
    """Columns file, start, inside (the split begins inside quotes), line.  ``part`` of the result: 0 a whole record,
    1 the end of one (or its middle), 2 its beginning."""
    at, held, inside, first = None, [], False, False
    out: tuple[list, list, list, list] = ([], [], [], [])

    def emit(part: int) -> None:
        nonlocal held, first
        record = b"\n".join(held)
        held = []
        if part == 0:
            record = record.removesuffix(b"\r")
            if header and first:
                first = False
                return
            first = False
            if not record:
                return
        for own, x in zip(out, (*at, part, record)):
            own.append(x)

    def end_of_split() -> None:
        if at is not None and held:
            emit(1 if opened else 2)

    def batch() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
            out, (pa.string(), pa.int64(), pa.int32(), pa.binary()))], names=["file", "start", "part", "record"])
        for c in out:
            c.clear()
        return b

    opened = False  # still in the record that an earlier split began
    for b in batches:
        odd = pc.bit_wise_and(pc.count_substring(b.column(3), QUOTE), 1).to_numpy(zero_copy_only=False).astype(bool)
        files, starts, insides, lines = (c.to_pylist() for c in b.columns)
        for f, s, i, q, line in zip(files, starts, insides, odd.tolist(), lines):
            if (f, s) != at:
                end_of_split()
                at, held, inside, opened, first = (f, s), [], i, i, s == 0
            held.append(line)
            inside ^= q
            if not inside:
                emit(1 if opened else 0)
                opened = False
        yield batch()
    end_of_split()
    yield batch()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the split), line (bytes without the line feed)."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                      F.col("value").cast("binary").alias("line"))


def read_records(spark: SparkSession, path: str, *, encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """Every column of the CSV file or folder as text, named by the header of the first file."""
    if encoding.upper() not in SPLIT_ENCODINGS:
        return (spark.read.options(**CSV_OPTIONS).option("header", header).option("encoding", encoding)
                .option("multiLine", True).csv(path))
    names = (spark.read.options(**CSV_OPTIONS).option("header", header).option("encoding", encoding)
             .option("inferSchema", False).csv(path).columns)
    lines = read_lines(spark, path)
    # latin-1 gives every byte one character, so quotes can be counted whatever the encoding
    quotes = F.regexp_count(F.decode("line", "ISO-8859-1"), F.lit(QUOTE))
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
              .select("file", "start", (F.coalesce(F.sum("quotes").over(order), F.lit(0)) % 2 == 1).alias("inside")))
    parts = (lines.join(F.broadcast(splits), ["file", "start"])  # one row a split
             .select("file", "start", "inside", "line")
             .mapInArrow(lambda it: join_lines(it, header), FRAGMENT))
    # a beginning opens a group; ends and middles follow it
    place = Window.partitionBy("file").orderBy("start", "part")
    broken = (parts.where("part > 0").withColumn("opens", F.sum((F.col("part") == 2).cast("int")).over(place))
              .groupBy("file", "opens")
              .agg(F.array_sort(F.collect_list(F.struct("start", "part", F.decode("record", encoding).alias("t"))))
                   .alias("pieces"))
              .select(F.regexp_replace(F.array_join(F.col("pieces.t"), "\n"), "\r$", "").alias("record")))
    whole = parts.where("part = 0").select(F.decode("record", encoding).alias("record"))
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    return whole.unionByName(broken).select(F.from_csv("record", schema, CSV_OPTIONS).alias("r")).select("r.*")
