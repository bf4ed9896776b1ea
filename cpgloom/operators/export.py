"""Phenotype-matrix export: filters, imputation, region selection and the wide form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matrix import each_sample

MAX = 10000.0
ALL_MISSING, BELOW, REMAINING, CONSTANT, WRITTEN = "all_missing", "below_presence", "remaining_missing", "constant", "written"


def label_rows(rows: DataFrame, view: DataFrame, samples: DataFrame, min_present: float = 1.0, missing: str = "drop") -> DataFrame:
    """Each row's fate under the export filters, with its statistics over the selected samples:
    all missing, below the presence threshold, still missing (``drop`` only), constant (after
    imputation), else written."""
    if missing not in ("drop", "mean"):
        raise ValueError(missing)
    n_samples = samples.count()
    st = view.join(samples.select("sample_id"), "sample_id").groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("value").alias("s")
    )
    x = rows.select("row_id").join(st, "row_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    label = (
        F.when(F.col("n") == 0, ALL_MISSING)
        .when(F.col("n") / F.lit(float(n_samples)) < min_present, BELOW)
        .when((F.col("n") < n_samples) & F.lit(missing == "drop"), REMAINING)
        .when(F.col("lo") == F.col("hi"), CONSTANT)
        .otherwise(WRITTEN)
    )
    return x.select("row_id", F.col("n").alias("n_observed"), F.expr("try_divide(s, n)").alias("row_mean"), label.alias("label"))


def receipt(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


def dense_rows(labels: DataFrame, view: DataFrame, samples: DataFrame) -> DataFrame:
    """Every cell of the written rows; a missing one holds the mean of its row, and is marked."""
    keep = labels.where(F.col("label") == WRITTEN).select("row_id", "row_mean")
    cells = each_sample(keep, samples).join(view.select("row_id", "sample_id", "value"), ["row_id", "sample_id"], "left")
    return cells.select(
        "row_id", "sample_id", (F.coalesce(F.col("value").cast("double"), F.col("row_mean")) / MAX).alias("fraction"), F.col("value").isNull().cast("int").alias("imputed")
    )


def in_region(df: DataFrame, chrom: str, start: int, end: int, grouped: bool = False) -> DataFrame:
    """Groups that overlap a half-open region keep their full bounds; single positions lie in it."""
    at = F.col("chrom") == chrom
    if grouped:
        return df.where(at & (F.col("start") < end) & (F.col("end") > start))
    return df.where(at & (F.col("pos0") >= start) & (F.col("pos0") < end))


def wide(cells: DataFrame, order: list[tuple[str, str]], value: Column | None = None) -> DataFrame:
    """One column per selected sample, in the given order and under the given name. The list is
    explicit, so no pass finds the columns; beyond a few thousand samples use ``packed``."""
    v = F.col("fraction") if value is None else value
    return cells.groupBy("row_id").agg(*[F.max(F.when(F.col("sample_id") == s, v)).alias(name) for s, name in order])


def packed(cells: DataFrame, order: DataFrame) -> DataFrame:
    """One array per row in roster order (``sample_id, col_ord``), for any number of samples."""
    x = cells.join(order, "sample_id")
    return x.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_ord", "fraction"))), lambda e: e["fraction"]).alias("fractions"))
