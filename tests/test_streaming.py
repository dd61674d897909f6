"""Streaming daily pulse equals the batch per-day aggregate for every closed day."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from storelens.operators.summaries import total
from storelens.schema import BASE_COLUMNS
from storelens.sources.star import order_lines_from_star
from storelens.streaming.pulse import daily_pulse_stream, read_order_stream

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
def test_stream_pulse_matches_batch(spark):
    base = order_lines_from_star(spark, SF).select(*BASE_COLUMNS)
    d = tempfile.mkdtemp(prefix="storelens-stream-")
    src, ckpt = os.path.join(d, "in"), os.path.join(d, "ckpt")
    # arrive in three files, oldest orders first
    y = F.year("order_date")
    for lo, hi in [(1995, 1997), (1998, 1999), (2000, 2001)]:
        base.where((y >= lo) & (y <= hi)).coalesce(1).write.mode("append").parquet(src)
    q = (daily_pulse_stream(read_order_stream(spark, src, max_files_per_trigger=1), "2 days")
         .writeStream.format("memory").queryName("pulse_test").outputMode("append")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r["order_day"]: (r["sales"], r["profit"], r["orders"]) for r in spark.table("pulse_test").collect()}
    want = {r["order_day"]: (r["sales"], r["profit"], r["orders"]) for r in
            base.groupBy(F.col("order_date").alias("order_day"))
            .agg(total("sales").alias("sales"), total("profit").alias("profit"),
                 F.count_distinct("order_id").alias("orders")).collect()}
    assert got, "no day was closed"
    assert all(got[k] == want[k] for k in got)
    # only the days still inside the lateness allowance stay open
    last = max(want)
    assert set(want) - set(got) <= {k for k in want if (last - k).days <= 3}
