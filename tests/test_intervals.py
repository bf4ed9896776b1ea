import random

import pytest
from pyspark.sql import functions as F

from cpgloom.operators.intervals import periods_and_gaps, segment_periods

SCHEMA = "who string, a long, b long"


def brute(rows):
    out, by = set(), {}
    for k, a, b in rows:
        if k is not None and a is not None and b is not None and b > a:
            by.setdefault(k, []).append((a, b))
    for k, xs in by.items():
        merged = []
        for a, b in sorted(xs):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {("period", k, a, b) for a, b in merged}
        out |= {("gap", k, x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def run(spark, rows, **kw):
    df = periods_and_gaps(spark.createDataFrame(rows, SCHEMA), ["who"], "a", "b", **kw)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("kw", [{}, dict(hot_rows=100, bin_width=3), dict(hot_rows=0, bin_width=16), dict(hot_rows=100)])
def test_against_brute_force(spark, seed, kw):
    r = random.Random(seed)
    rows = []
    for _ in range(400):
        a = r.randrange(-40, 400)
        rows.append((r.choice(["hot"] * 5 + ["x", "y", None]), r.choice([a, a, a, None]), a + r.randrange(-2, 30)))
    rows += rows[:50]
    assert run(spark, rows, **kw) == brute(rows)


def test_touching_nested_and_far_apart(spark):
    rows = [("k", 0, 5), ("k", 5, 9), ("k", 1, 3), ("k", 50, 60), ("k", 50, 60), ("k", 7, 7), ("k", 9, 2)]
    for kw in ({}, dict(hot_rows=0, bin_width=4)):
        assert run(spark, rows, **kw) == {("period", "k", 0, 9), ("period", "k", 50, 60), ("gap", "k", 9, 50)}


def test_empty_table_and_only_unusable_rows(spark):
    assert run(spark, []) == set()
    assert run(spark, [(None, 1, 2), ("k", None, 2), ("k", 3, None), ("k", 4, 4)]) == set()


def test_clashing_columns_are_ignored(spark):
    df = spark.createDataFrame([("k", 1, 4, 9, "z")], "bin string, x long, s long, e long, kind string")
    got = periods_and_gaps(df, ["bin"], "x", "s").collect()
    assert [tuple(r) for r in got] == [("period", "k", 1, 4)]


def test_spellings_of_segments(spark):
    rows = [("S", " CHR3 ", 1, 5, "Same "), ("S", "3", 5, 8, "same"), ("S", "chrx", 1, 2, "SAME"), ("S", "X", 4, 6, "same"), ("S", "chr3", 1, 9, " "), (" ", "chr3", 1, 9, "same")]
    df = segment_periods(spark.createDataFrame(rows, "sample_id string, chrom string, chrom_start long, chrom_end long, name string"))
    got = {tuple(r) for r in df.collect()}
    assert got == {("period", "S", "chr3", "same", 1, 8), ("period", "S", "chrX", "same", 1, 2), ("gap", "S", "chrX", "same", 2, 4), ("period", "S", "chrX", "same", 4, 6)}


def test_hot_entity_is_spread(spark):
    """One entity holds nearly all rows; its bins are separate units of work."""
    n = 60000
    df = spark.range(n).select(F.lit("hot").alias("who"), (F.col("id") * 10).alias("a"), (F.col("id") * 10 + 4).alias("b"))
    out = periods_and_gaps(df, ["who"], "a", "b", hot_rows=1000, bin_width=1000).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in out} == {"period": n, "gap": n - 1}
