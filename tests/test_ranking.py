"""Exact rank buckets against pandas qcut(rank(method='first'))."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from storelens.operators.ranking import kth_keys, pct_ranks, rank_buckets


def pandas_quartiles(values):
    """Reference semantics: qcut of first-rank (ties by position) into 4."""
    s = pd.Series(values, dtype="float64")
    if s.notna().sum() == 1:
        return [1 if v is not None else None for v in values]
    q = pd.qcut(s.rank(method="first"), 4, labels=[1, 2, 3, 4])
    return [None if pd.isna(x) else int(x) for x in q]


def spark_quartiles(spark, values, **kw):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos int, v double")
    b = rank_buckets(df, [F.col("v"), F.col("pos")], 4, **kw)
    return [r["b"] for r in df.select("pos", b.alias("b")).orderBy("pos").collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 8, 11, 40])
def test_quartiles_small_n(spark, n):
    vals = [float(random.Random(n).randint(0, 5)) for _ in range(n)]
    assert spark_quartiles(spark, vals) == pandas_quartiles(vals)


def test_fixture_counts(spark):
    assert spark_quartiles(spark, [1.0] * 6) == [1, 1, 2, 3, 4, 4]
    assert spark_quartiles(spark, [float(x) for x in range(7)]) == [1, 1, 2, 2, 3, 4, 4]


def test_nulls_get_no_bucket(spark):
    vals = [3.0, None, 1.0, 2.0, None, 5.0]
    assert spark_quartiles(spark, vals) == pandas_quartiles(vals)


def test_iterative_search_with_hot_value(spark):
    # a third of the rows share one value; force the sampled, multi-round path
    rnd = random.Random(7)
    vals = [42.0 if i % 3 == 0 else float(rnd.randint(0, 300)) for i in range(3001)]
    got = spark_quartiles(spark, vals, fanout=8)
    assert got == pandas_quartiles(vals)


def test_kth_keys_matches_sort(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 20), f"id{i:05d}") for i in range(2000)]
    df = spark.createDataFrame(rows, "v int, id string").select(F.struct(F.col("v").alias("k0"),
                                                                        F.col("id").alias("k1")).alias("key"))
    ranks = [1, 17, 500, 1000, 1999, 2000]
    got = kth_keys(df, ranks, fanout=4)
    srt = sorted(rows)
    assert {r: tuple(got[r]) for r in ranks} == {r: srt[r - 1] for r in ranks}


def test_pct_ranks_are_those_of_pandas(spark):
    rng = random.Random(6)
    a = [3.0, 1.0, 3.0, 2.0, None] + [rng.choice([None, 7.5, rng.random(), rng.randrange(5)]) for _ in range(500)]
    b = [None if rng.random() < 0.1 else -0.0 if rng.random() < 0.4 else 0.0 if rng.random() < 0.1 else rng.gauss(0, 1)
         for _ in a]
    df = spark.createDataFrame([(i, None if x is None else float(x), y) for i, (x, y) in enumerate(zip(a, b))],
                               "pos int, v double, w double").repartition(7)
    got = pct_ranks(df, {"p": F.col("v"), "q": F.lit(1.0) - F.col("w")}).orderBy("pos").toPandas()
    assert list(got.columns) == ["pos", "v", "w", "p", "q"] and len(got) == len(a)
    for have, ref in ((got["p"], pd.Series(a, dtype=float).rank(pct=True)), (got["q"], (1 - pd.Series(b, dtype=float)).rank(pct=True))):
        assert have.isna().equals(ref.isna()) and (have.dropna() == ref.dropna()).all()
    plan = pct_ranks(df, {"p": F.col("v")})._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan  # no window over all rows
    assert pct_ranks(df.where("false"), {"p": F.col("v")}).count() == 0


@pytest.mark.parametrize("fanout", [4, 64])
def test_rank_buckets_many_matches_single(spark, fanout):
    from storelens.operators.ranking import rank_buckets_many
    rnd = random.Random(11)
    rows = [(i, float(rnd.randint(0, 9)), None if i % 17 == 0 else float(rnd.randint(0, 3))) for i in range(400)]
    df = spark.createDataFrame(rows, "pos int, a double, b double")
    a, b = rank_buckets_many(df, [[-F.col("a"), F.col("pos")], [F.col("b"), F.col("pos")]], 4,
                             fanout=fanout)
    got = df.select("pos", a.alias("a"), b.alias("b")).orderBy("pos").collect()
    want_a = pandas_quartiles([-r[1] for r in rows])
    want_b = pandas_quartiles([r[2] for r in rows])
    assert [g["a"] for g in got] == want_a and [g["b"] for g in got] == want_b


def test_key_literals_round_trip(spark):
    # cut keys are rendered as SQL text; awkward text and special values survive
    import datetime as dt
    from decimal import Decimal

    from storelens.operators.ranking import _key_literal
    schema = ("s string, d decimal(18,4), x double, i long, t date")
    rows = [("it's a \\ \"test\" ü ✓ \n", Decimal("-12.3400"), float("nan"), -7, dt.date(1999, 12, 31)),
            ("", Decimal("0.0001"), float("-inf"), 2 ** 40, dt.date(2024, 2, 29)),
            (None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema).select(F.struct("s", "d", "x", "i", "t").alias("key"))
    key_type = df.schema["key"].dataType
    for row in rows:
        got = spark.range(1).select(_key_literal(row, key_type).alias("key")).first()["key"]
        for a, b in zip(tuple(got), row):
            assert (a != a and b != b) or a == b
        # and the literal equals the same key built from data (struct order: null fields equal)
        assert df.where(F.col("key") == _key_literal(row, key_type)).count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_kth_keys_many_ranges_narrowing(spark, seed):
    # many disjoint live ranges over several rounds; the candidate set shrinks each round
    rnd = random.Random(seed)
    rows = [(rnd.choice([5, 5, 5, rnd.randint(0, 1000)]), f"r{i:05d}") for i in range(5000)]
    df = spark.createDataFrame(rows, "v int, id string").select(F.struct(F.col("v").alias("k0"),
                                                                        F.col("id").alias("k1")).alias("key"))
    ranks = sorted(rnd.sample(range(1, 5001), 9))
    got = kth_keys(df, ranks, fanout=4, seed=seed)
    srt = sorted(rows)
    assert {r: tuple(got[r]) for r in ranks} == {r: srt[r - 1] for r in ranks}


def test_search_runs_no_window(spark, monkeypatch):
    from storelens.operators import ranking
    plans = []
    for name in ("_sample_cuts", "_count_buckets"):
        real = getattr(ranking, name)

        def seen(current, *a, real=real):
            plans.append(current._jdf.queryExecution().toString())
            return real(current, *a)
        monkeypatch.setattr(ranking, name, seen)
    df = spark.range(500).selectExpr("id", "cast(id % 7 as double) as a", "cast(id % 3 as double) as b")
    cols = ranking.rank_buckets_many(df, [[F.col("a"), F.col("id")], [F.col("b"), F.col("id")]], 4, fanout=8)
    plans.append(df.select(*cols)._jdf.queryExecution().toString())
    assert len(plans) > 4 and not any("Window" in p for p in plans)


# ---------------------------------------------------------------- stored histograms

def test_appended_files_narrow_the_search_at_once(spark, tmp_path):
    from decimal import Decimal

    from storelens.operators.ranking import KeyHistogram
    rng = random.Random(8)
    path = str(tmp_path / "lines")

    def append(rows):
        spark.createDataFrame(rows, "sales decimal(18,4), row_id string, other int").coalesce(2).write.mode("append").parquet(path)

    def rows(n, at, lo, hi):
        return [(None if rng.random() < 0.05 else Decimal(rng.randrange(lo, hi)) / 4, f"r{at + i:06d}", 1) for i in range(n)]

    data = rows(3000, 0, 0, 400)
    append(data)
    ranks = lambda n: [1, n // 4, n // 2, 3 * n // 4, n]

    def check(new_files):
        table = spark.read.parquet(path)
        hist = KeyHistogram(spark, str(tmp_path / "hist"), ["sales", "row_id"], size=64)
        srt = sorted((s, r) for s, r, _ in data if s is not None)
        before = hist._stored()
        got = hist.keys_at(table, ranks)
        assert got == {k: srt[k - 1] for k in ranks(len(srt)) if k >= 1}
        after = hist._stored()
        assert len(set(after[0]) - set(before[0] if before else [])) == new_files
        assert after[3] == len(srt) and sum(after[2].values()) == len(srt)

    check(2)
    check(0)   # nothing new: no file is read for counts
    more = rows(500, 5000, 100, 300)
    data += more
    append(more)
    check(2)
    skewed = [(Decimal(50), f"s{i:06d}", 1) for i in range(4000)] + rows(50, 20000, 10 ** 6, 10 ** 7)
    data += skewed  # one value with most rows, and values beyond all cuts
    append(skewed)
    check(2)


def test_histogram_of_an_empty_table(spark, tmp_path):
    from storelens.operators.ranking import KeyHistogram
    path = str(tmp_path / "none")
    spark.createDataFrame([], "sales decimal(18,4), row_id string").write.parquet(path)
    hist = KeyHistogram(spark, str(tmp_path / "h"), ["sales", "row_id"])
    assert hist.keys_at(spark.read.parquet(path), lambda n: [1, n]) == {}


def test_a_search_reads_only_the_candidate_range(spark, tmp_path):
    from storelens.operators.ranking import KeyHistogram
    path = str(tmp_path / "t")
    spark.range(20000).selectExpr("cast(id as decimal(18,4)) as sales", "cast(id as string) as row_id").write.parquet(path)
    hist = KeyHistogram(spark, str(tmp_path / "h"), ["sales", "row_id"])
    cuts, counts, n, _ = hist.refresh(spark.read.parquet(path))
    assert n == 20000 and max(counts.values()) < 500  # a wanted rank is looked for among these rows
    assert float(hist.keys_at(spark.read.parquet(path), lambda n: [n // 2])[10000][0]) == 9999.0
