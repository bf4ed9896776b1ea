"""The N best items of every group (problem 2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: a run without its own number keeps this many hotspots per category and direction.
DEFAULT_TOP_N = 500
_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def allow_group_limit(spark, n: int) -> None:
    """Raise Spark's own threshold where a limit of ``n`` rows would lose the group-limit operator."""
    if n >= int(spark.conf.get(_LIMIT_CONF, "1000")):
        spark.conf.set(_LIMIT_CONF, str(n + 1))


def last_version(df: DataFrame, key: str, loaded: str) -> DataFrame:
    """Of rows with one ``key`` the one loaded last (a null time is earliest). Rows that tie on the
    time are ordered by all their other columns that can be ordered, so the outcome is the same each
    time. Rows with a null key stand for themselves and are all kept."""
    rest = [c for c in df.columns if c not in (key, loaded) and df.schema[c].dataType.simpleString()[:3] not in ("map", "var")]
    w = Window.partitionBy(key).orderBy(
        F.col(f"`{loaded}`").desc_nulls_last(), *[F.col(f"`{c}`").desc_nulls_last() for c in rest]
    )
    one = df.where(F.col(f"`{key}`").isNotNull()).withColumn("rn__", F.row_number().over(w))
    one = one.where(F.col("rn__") <= 1).drop("rn__")
    return one.unionByName(df.where(F.col(f"`{key}`").isNull()))


def top_n_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    largest: int,
    n: Column | None = None,
) -> DataFrame:
    """The rows of ``df`` of rank up to ``n`` (a column, else ``largest``) in their group, with
    ``rank__``. ``order`` must end in an identifier, which makes it total; null group values form one
    group. ``largest`` is the greatest ``n`` of all rows; with it as a literal, Spark's group-limit
    operator keeps that many rows per group and task before the shuffle, and again after it, so a
    group of millions never reaches one task whole. Nothing is returned for ``largest`` below 1.
    """
    allow_group_limit(df.sparkSession, largest)
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn("rank__", F.row_number().over(w)).where(F.col("rank__") <= F.lit(int(largest)))
    return ranked if n is None else ranked.where(F.col("rank__") <= n)


def number(c: str) -> Column:
    """NaN counts as null, minus zero as zero."""
    return F.when(~F.isnan(c), F.col(c) + F.lit(0.0))


def normal_direction(c: Column) -> Column:
    d = F.lower(F.regexp_replace(c, r"\s+", ""))
    return F.when(d.isin("plus>minus", "minus>plus"), d)


def top_hotspots(hotspot: DataFrame, config: DataFrame) -> DataFrame:
    """Problem 2: ``run_id, category, direction, hotspot_id`` of each kept hotspot.

    Rank by max_hotspot_score, max_abs_mean_diff and n_cpgs, all descending with nulls last, then by
    hotspot_id. A run with a null number, or without a configuration, has the default of 500; 0 or
    less keeps none. Of several configurations of a run the largest number counts.
    """
    cols = ["hotspot_id", "run_id", "category", "direction", "max_hotspot_score", "max_abs_mean_diff", "n_cpgs", "loaded_at"]
    rows = last_version(hotspot.select(*cols), "hotspot_id", "loaded_at").select(
        "hotspot_id",
        "run_id",
        "category",
        normal_direction(F.col("direction")).alias("direction"),
        number("max_hotspot_score").alias("score"),
        number("max_abs_mean_diff").alias("diff"),
        "n_cpgs",
    )
    rows = rows.where(F.col("direction").isNotNull() & F.col("score").isNotNull())
    n = F.max(F.coalesce("top_n_hotspots", F.lit(DEFAULT_TOP_N))).alias("n__")
    per_run = config.groupBy("run_id").agg(n)
    largest = per_run.agg(F.max("n__")).first()[0]  # one number
    largest = max(DEFAULT_TOP_N, largest or 0)
    order = [F.col("score").desc(), F.col("diff").desc_nulls_last(), F.col("n_cpgs").desc_nulls_last(), F.col("hotspot_id").asc()]
    best = top_n_per_group(rows, ["run_id", "category", "direction"], order, largest)
    kept = best.join(per_run, "run_id", "left").where(F.col("rank__") <= F.coalesce("n__", F.lit(DEFAULT_TOP_N)))
    return kept.select("run_id", "category", "direction", "hotspot_id")
