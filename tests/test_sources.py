"""CSV source (header row, Latin-1, reference column names) and the batch sinks."""

import os
import tempfile

from pyspark.sql import functions as F

from storelens.operators.derive import enrich
from storelens.operators import summaries
from storelens.sources.csv import read_order_csv

CSV = """Row ID,Order ID,Order Date,Ship Date,Ship Mode,Customer ID,Customer Name,Segment,Country,City,State,Postal Code,Region,Product ID,Category,Sub-Category,Product Name,Sales,Quantity,Discount,Profit
1,CA-1,11/8/2016,11/11/2016,Second Class,CG-1,Claire Gute,Consumer,United States,Henderson,Kentucky,42420,South,P-1,Furniture,Bookcases,Bush,261.96,2,0,41.9136
2,CA-1,11/8/2016,11/11/2016,Second Class,CG-1,Claire Gute,Consumer,United States,Henderson,Kentucky,42420,South,P-2,Furniture,Chairs,Hon,731.94,3,0,219.582
3,CA-2,6/12/2016,6/16/2016,Second Class,DV-1,Darrin Van Huff,Corporate,United States,Los Angeles,California,90036,West,P-3,Office Supplies,Labels,Self,14.62,2,0,6.8714
4,US-3,10/11/2015,10/18/2015,Standard Class,SO-1,Se\xf1or Osborne,Consumer,United States,Fort Lauderdale,Florida,33311,South,P-4,Furniture,Tables,Bretford,957.5775,5,0.45,-383.031
"""


def test_csv_source_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="storelens-csv-")
    path = os.path.join(d, "orders.csv")
    with open(path, "wb") as fh:
        fh.write(CSV.encode("latin-1"))
    base = read_order_csv(spark, path)
    ol = enrich(base)
    rows = ol.orderBy("row_id").collect()
    assert len(rows) == 4
    assert rows[3]["customer_name"] == "Señor Osborne"
    assert rows[3]["discount_band"] == "41%+" and rows[3]["is_loss"] == 1
    assert rows[0]["shipping_days"] == 3 and rows[0]["order_quarter"] == "2016Q4"
    assert [r["sales_band"] for r in rows] == ["Medium", "High", "Low", "Very High"]
    states = {r["state"]: r["sales"] for r in summaries.state_summary(ol).collect()}
    assert states["Kentucky"] == 993.9
    # the pass-through columns of the file survive the read
    assert "Postal Code" in base.columns


def test_batch_writes_small_tables(spark):
    from storelens.plans.batch import run_batch
    from storelens.sources.sinks import read_csv
    from storelens.operators import kpis
    from storelens.sources.loader import load_order_lines
    src = "/root/testdata/sf0.001"
    out = tempfile.mkdtemp(prefix="storelens-batch-")
    small = dict(num_trees=2, max_depth=2)
    paths = run_batch(spark, src, out, model_params={"loss": small, "profit": small})
    want = kpis.kpi_summary(load_order_lines(spark, src))
    got = read_csv(spark, paths["kpi_summary"], want.schema)
    rows = {r["metric"]: r["value"] for r in got.collect()}
    assert len(rows) == want.count() + 4  # and the four model rows
    assert {r["metric"]: r["value"] for r in want.collect()}.items() <= rows.items()
    assert read_csv(spark, paths["top_states"], "state string, region string, sales double, profit double, "
                    "orders long, avg_discount double").count() == 20


def test_written_sql_store_is_partitioned_and_pruned(spark):
    import os

    from storelens.plans import sqlviews
    from storelens.sources.loader import load_order_lines
    ol = load_order_lines(spark, "/root/testdata/sf0.001")
    path = sqlviews.write_sql_store(spark, ol)
    local = path[len("file:"):] if path.startswith("file:") else path
    years = sorted(d for d in os.listdir(local) if d.startswith("order_year="))
    assert years and len(years) == ol.select("order_year").distinct().count()
    back = sqlviews.read_sql_store(spark, path)
    assert back.columns == sqlviews.orders_table(ol).columns and back.count() == ol.count()
    one = back.where("order_year = 1995")
    p = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_year" in p and "(order_year#" in p
    assert one.count() == ol.where("order_year = 1995").count()


def test_sql_store_is_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    import glob

    from pyspark.sql import DataFrameWriter
    from storelens.plans import sqlviews
    from storelens.sources.loader import load_order_lines
    rows = [_line(i).replace("2016-11-08", f"{2013 + i % 4}-11-08") for i in range(1, 41)]
    ol = load_order_lines(spark, _csv(tmp_path, rows), date_format="yyyy-MM-dd", with_sales_band=False)
    plans, real = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (
        plans.append(self._df._jdf.queryExecution().executedPlan().toString()), real(self, *a, **k))[1])
    path = sqlviews.write_sql_store(spark, ol)
    assert len(plans) == 1 and "hashpartitioning" not in plans[0] and "REBALANCE" not in plans[0]
    assert {f.split(".")[-2] for f in glob.glob(f"{path.removeprefix('file:')}/order_year=*/*.parquet")} == {"zstd"}
    got = sqlviews.read_sql_store(spark, path)
    assert sorted(map(str, got.collect())) == sorted(map(str, sqlviews.orders_table(ol).collect()))


def _csv(tmp_path, rows, header=CSV.splitlines()[0]):
    path = tmp_path / "orders.csv"
    path.write_bytes("\n".join([header, *rows, ""]).encode("latin-1"))
    return str(path)


def _line(i, sales=10, quantity=1, city="Ulm"):
    return (f"{i},O-{i},2016-11-08,2016-11-11,First,C-1,Ann,Consumer,DE,{city},Ohio,1,East,P-1,Office,Paper,Pen,"
            f"{sales},{quantity},0,1")


def test_ties_follow_the_files_row_order(spark, tmp_path):
    import pandas as pd

    from storelens.operators import monitor, quality
    from storelens.sources.loader import load_order_lines
    path = _csv(tmp_path, [_line(i, quantity=i) for i in range(1, 13)])
    ol = load_order_lines(spark, path, date_format="yyyy-MM-dd")
    got = [r["sales_band"] for r in ol.orderBy("row_id").collect()]
    want = pd.qcut(pd.Series([10.0] * 12).rank(method="first"), 4, labels=["Low", "Medium", "High", "Very High"])
    assert got == list(want)
    sample = {r["column"]: r["sample_value"] for r in quality.data_quality(ol.where("row_id >= 2")).collect()}
    assert sample["Quantity"] == "2"
    assert [r["order_id"] for r in monitor.recent_orders(ol, 3).collect()] == ["O-1", "O-2", "O-3"]


def test_every_column_of_the_csv_passes_through(spark, tmp_path):
    from storelens.plans import sqlviews
    from storelens.sources.loader import load_order_lines
    from storelens.sources.sinks import export_filtered, read_csv
    folder = tmp_path / "in"
    folder.mkdir()
    _csv(folder, [_line(1), _line(2, city="Bern")])
    ol = load_order_lines(spark, str(folder), date_format="yyyy-MM-dd")
    sqlviews.register_sql_store(spark, ol)
    assert [r["City"] for r in sqlviews.run_sql(spark, 'select City from orders order by "Row ID"').collect()] == [
        "Ulm", "Bern"]
    back = read_csv(spark, export_filtered(spark, ol), ol.schema)
    assert back.columns == ol.columns and {"City", "Country", "Postal Code", "Product ID", "Product Name"} <= set(back.columns)
    stored = sqlviews.read_sql_store(spark, sqlviews.write_sql_store(spark, ol))
    assert stored.columns == sqlviews.orders_table(ol).columns
    assert sorted(r["City"] for r in stored.collect()) == ["Bern", "Ulm"]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    import pytest

    from storelens.session import shared_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_the_session_leaves_the_master_alone(monkeypatch):
    from pyspark.sql import SparkSession

    from storelens import session
    asked = {}

    class Builder:
        def appName(self, n):
            return self

        def master(self, m):
            asked["master"] = m
            return self

        def config(self, k, v):
            asked[k] = v
            return self

        def getOrCreate(self):
            return type("S", (), {"sparkContext": type("C", (), {"setLogLevel": lambda self, x: None})()})()
    monkeypatch.setattr(SparkSession, "builder", Builder())
    session.build_session()
    assert "master" not in asked and "spark.driver.memory" not in asked
    session.build_session("local[2]")
    assert asked["master"] == "local[2]" and asked["spark.driver.memory"] == "8g"


# ---------------------------------------------------------------- RFC 4180

TRICKY = ['Drawer Files, 18" wide, black', '46" x 60" Chairmat', 'two\nlines', 'a\r\nb, "c"\n\nd', '""', ' spaces ', '"',
          "it's, fine", 'tail"', '"head', "\\", 'back\\"slash', "\n", "x" * 300]


def _quoted(text):
    return '"' + text.replace('"', '""') + '"'


def _tricky_file(path, names, end="\n", encoding="latin-1"):
    lines = [CSV.splitlines()[0]]
    for i, name in enumerate(names):
        lines.append(f"{i},O-{i},11/8/2016,11/11/2016,First,C-1,Ann,Consumer,DE,Ulm,Ohio,1,East,P-1,Office,Paper,"
                     f"{_quoted(name)},10,1,0,1")
    path.write_bytes((end.join(lines) + end).encode(encoding))


def test_quoted_fields_survive_read_and_export(spark, tmp_path):
    from storelens.sources.sinks import export_filtered, read_csv
    for end in ("\n", "\r\n"):
        path = tmp_path / f"in{len(end)}.csv"
        _tricky_file(path, TRICKY, end)
        got = read_order_csv(spark, str(path))
        assert {r["row_id"]: r["Product Name"] for r in got.collect()} == dict(enumerate(TRICKY))
        back = read_csv(spark, export_filtered(spark, got), got.schema)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, got.collect()))


def test_exported_files_can_be_read_by_others(spark, tmp_path):
    import csv
    import glob

    from storelens.sources.sinks import export_filtered
    path = tmp_path / "in.csv"
    _tricky_file(path, TRICKY)
    out = export_filtered(spark, read_order_csv(spark, str(path)), str(tmp_path / "out"))
    names = []
    for part in glob.glob(f"{out}/part-*.csv"):
        with open(part, newline="", encoding="utf-8") as fh:
            names += [r["Product Name"] for r in csv.DictReader(fh)]
    assert sorted(names) == sorted(TRICKY)


def test_records_that_cross_splits_are_put_together(spark, tmp_path):
    import random
    rng = random.Random(4)
    folder = tmp_path / "in"
    folder.mkdir()
    want = []
    for f in range(3):  # long quoted fields over many splits, short ones between them
        names = [rng.choice(TRICKY) if rng.random() < 0.7 else "\n".join(
            rng.choice(['line, "quoted"', "plain", "", '"']) for _ in range(rng.randrange(400))) for _ in range(60)]
        _tricky_file(folder / f"f{f}.csv", names, rng.choice(["\n", "\r\n"]))
        want += names
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        from storelens.sources.records import read_lines
        assert read_lines(spark, str(folder)).rdd.getNumPartitions() > 50
        got = read_order_csv(spark, str(folder)).select("Product Name").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(r[0] for r in got) == sorted(want)


def test_broken_records_fail_the_read(spark, tmp_path):
    import pytest
    path = tmp_path / "in.csv"
    _tricky_file(path, ["fine"])
    with open(path, "a") as fh:
        fh.write("1,too,short\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|malformed|Malformed"):
        read_order_csv(spark, str(path)).collect()


def test_other_encodings_and_empty_files(spark, tmp_path):
    path = tmp_path / "u8.csv"
    _tricky_file(path, ["Señor 漢字\n\"x\""], encoding="utf-8")
    assert read_order_csv(spark, str(path), encoding="UTF-8").first()["Product Name"] == "Señor 漢字\n\"x\""
    path = tmp_path / "u16.csv"
    _tricky_file(path, ["Señor\n\"x\""], encoding="utf-16")
    assert read_order_csv(spark, str(path), encoding="UTF-16").first()["Product Name"] == "Señor\n\"x\""
    path = tmp_path / "none.csv"
    path.write_text(CSV.splitlines()[0] + "\n")
    assert read_order_csv(spark, str(path)).count() == 0
