import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cpgloom.llm.percentiles import combined_percentiles, group_percentiles, merge_states, multi_select, percentile_state, track_percentiles

P = (5, 25, 50, 75, 95, 99)


def brute(xs):
    xs = sorted(xs)
    return [xs[(len(xs) * p + 99) // 100 - 1] for p in P] if xs else [None] * 6


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(2)
    rows = [("hot", r.choice([r.randrange(4000), 17, 17])) for _ in range(6000)] + [("b", r.randrange(-50, 50)) for _ in range(300)]
    rows += [("one", 3), (None, 1), (None, 2), ("void", None)]
    return rows, spark.createDataFrame(rows, "k string, v long").repartition(5)


@pytest.mark.parametrize("kw", [dict(local_rows=8, proposers=4), dict(local_rows=8, proposers=1), dict(local_rows=64, proposers=3, broadcast_rows=0), dict(local_rows=1 << 20)])
def test_groups_against_brute_force(spark, data, kw):
    rows, df = data
    df = df.withColumn("n", F.lit("clash")).withColumn("g", F.lit(1)).withColumn("p05", F.lit(0))
    got = {r["k"]: r for r in group_percentiles(df, ["k"], {"v": F.col("v")}, **kw).collect()}
    assert set(got) == {"hot", "b", "one", None, "void"}
    for k, r in got.items():
        xs = [v for g, v in rows if g == k and v is not None]
        assert r["n"] == len(xs) and [r[f"p{p:02d}"] for p in P] == brute(xs) and r["rank_error"] == 0


def test_values_keep_their_type(spark):
    r = random.Random(5)
    xs = [r.choice([r.random(), 0.75, -0.0, float("nan"), None]) for _ in range(3000)] + [1.75, 2.75]
    df = spark.createDataFrame([("k", x) for x in xs], "k string, v double").withColumn("w", F.round("v", 3).cast("decimal(12,3)")).withColumn("i", F.lit(7))
    real = [x + 0.0 for x in xs if x is not None and x == x]
    for rows in (64, 1 << 20):
        one = group_percentiles(df, ["k"], {"v": F.col("v")}, local_rows=rows, proposers=3).first()
        assert one["n"] == len(real) and [one[f"p{p:02d}"] for p in P] == brute(real)
        both = {x["field_name"]: x for x in group_percentiles(df, ["k"], {"v": F.col("v"), "i": F.col("i")}, local_rows=rows, proposers=3).collect()}
        assert [both["v"][f"p{p:02d}"] for p in P] == brute(real) and both["i"]["p50"] == 7.0
        exact = group_percentiles(df.where("NOT isnan(v)"), ["k"], {"w": F.col("w")}, local_rows=rows, proposers=3)
        assert exact.schema["p50"].dataType.simpleString() == "decimal(12,3)" and float(exact.first()["p75"]) == round(brute(real)[3], 3)


def test_states_combine(spark, data):
    rows, df = data
    parts = [df.where(F.pmod(F.col("v"), F.lit(3)) == i) for i in range(3)]
    states = [percentile_state(p, ["k"], {"v": F.col("v")}) for p in parts]
    m = merge_states(states, ["k"])
    assert m.agg(F.sum("n")).first()[0] == sum(v is not None for _, v in rows)
    got = {r["k"]: r for r in multi_select(m, ["k", "field_name"], local_rows=16, proposers=4).collect()}
    assert [got["hot"][f"p{p:02d}"] for p in P] == brute([v for k, v in rows if k == "hot"])
    whole = combined_percentiles(states, []).collect()
    assert [whole[0][f"p{p:02d}"] for p in P] == brute([v for _, v in rows if v is not None])
    assert multi_select(m.limit(0), ["k"]).count() == 0


def test_one_value_fills_a_group(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), F.lit(4).alias("v"))
    r = group_percentiles(df, ["k"], {"v": F.col("v")}, local_rows=4, proposers=2).first()
    assert (r["n"], r["p05"], r["p99"]) == (5000, 4, 4)


def test_an_observation_counts_once_on_its_first_day(spark):
    d = lambda n: dt.datetime(2024, 1, n)
    x = lambda i, v, c, at: (i, "5mC", "c", "c", "s", v, c, at)
    rows = [x(1, 10, 5, d(2)), x(1, 10, 5, d(1)), x(2, 20, 0, d(1)), x(3, 65535, 7, None), x(None, 30, 1, d(1)), x(None, 30, 1, d(1))]
    df = spark.createDataFrame(rows, "obs_id long, assay string, haplotype string, strand string, sample_id string, value_u16 int, coverage int, loaded_at timestamp")
    got = {(str(r["day"]), r["field_name"]): (r["n"], r["p50"]) for r in track_percentiles(df).collect()}
    assert got == {("2024-01-01", "value_u16"): (4, 20), ("2024-01-01", "coverage"): (3, 1), ("None", "value_u16"): (0, None), ("None", "coverage"): (1, 7)}
    assert track_percentiles(df.limit(0)).count() == 0
