import datetime as dt
import random

from pyspark.sql import functions as F

from cpgloom.llm.topn import last_version, top_hotspots, top_n_per_group

HOT = "hotspot_id long, run_id long, category string, direction string, max_hotspot_score double, max_abs_mean_diff double, n_cpgs int, loaded_at timestamp"
CONF = "run_id long, top_n_hotspots int"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def brute(rows, conf):
    last = {}
    for r in rows:
        if r[0] not in last or (r[7] or day(-999)) >= (last[r[0]][7] or day(-999)):
            last[r[0]] = r
    low = float("-inf")
    num = lambda v: None if v is None or v != v else v
    groups = {}
    for r in last.values():
        d = "".join((r[3] or "").split()).lower()
        if d in ("plus>minus", "minus>plus") and num(r[4]) is not None:
            groups.setdefault((r[1], r[2], d), []).append(r)
    out = set()
    for g, rs in groups.items():
        n = conf.get(g[0], 500)
        n = 500 if n is None else n
        rs.sort(key=lambda r: (-num(r[4]), -(low if num(r[5]) is None else num(r[5])), -(low if r[6] is None else r[6]), r[0]))
        out |= {(*g, r[0]) for r in rs[: max(0, n)]}
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    for i in range(600):
        rows.append((i % 500, r.choice([1, 1, 1, 2, 3, None]), r.choice(["a", "b", None]), r.choice(["plus>minus", " Plus > MINUS", "minus>plus", "both", None]),
                     r.choice([0.1, 0.2, 0.3, float("nan"), None, 0.0]), r.choice([0.1, float("nan"), None]), r.choice([1, 2, None]), day(i)))
    conf = {1: 7, 2: 0, 3: None}
    df = spark.createDataFrame(rows, HOT).withColumn("rank__", F.lit("clash"))
    got = [tuple(x) for x in top_hotspots(df, spark.createDataFrame(list(conf.items()), CONF)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, conf)


def test_plan_limits_before_and_after_the_shuffle(spark):
    df = spark.range(20000).select((F.col("id") % 3).alias("g"), "id")
    limits = lambda d: d._jdf.queryExecution().sparkPlan().toString().count("WindowGroupLimit")
    assert limits(top_n_per_group(df, ["g"], [F.col("id").desc()], 5)) == 2
    big = top_n_per_group(df, ["g"], [F.col("id").desc()], 5000)
    assert limits(big) == 2 and big.count() == 15000


def test_ties_repeats_and_empty_tables(spark):
    t = day(1)
    rows = [(9, 1, "a", "plus>minus", 0.5, None, 1, t), (9, 1, "a", "plus>minus", 0.5, None, 1, t), (8, 1, "a", "plus>minus", 0.5, None, 1, None), (7, 1, "a", "plus>minus", 0.5, None, None, t), (None, 1, "a", "plus>minus", 0.1, None, 1, t)]
    conf = spark.createDataFrame([(1, 2)], CONF)
    df = spark.createDataFrame(rows, HOT)
    assert sorted(x["hotspot_id"] for x in top_hotspots(df, conf).collect()) == [8, 9]
    assert top_hotspots(df.limit(0), conf).count() == 0
    assert top_hotspots(df, conf.limit(0)).count() == 4
    assert last_version(df, "hotspot_id", "loaded_at").count() == 4
