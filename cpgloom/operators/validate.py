"""Structural checks of row systems by one aggregate each; callers refuse what has violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import COVERAGE_MAX, VALUE_MAX


def _no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def interval_violations(df: DataFrame, by: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Counts of ``n_rows, n_negative, n_empty, n_repeated, n_overlapping`` intervals (``start, end``) within
    ``by``; a null counts as negative or empty."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max(F.when(F.col("end") > F.col("start"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    twice = (F.col("start") == F.lag("start").over(w)) & (F.col("end") == F.lag("end").over(w))
    x = df.select(*by, "start", "end").withColumns({"twice": twice, "over": F.col("start") < reach})
    return x.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(_no(F.col("start") >= 0)).alias("n_negative"), F.count_if(_no(F.col("end") > F.col("start"))).alias("n_empty"),
        F.count_if(F.coalesce("twice", F.lit(False))).alias("n_repeated"), F.count_if(F.coalesce("over", F.lit(False))).alias("n_overlapping"),
    )


def index_violations(index: DataFrame) -> DataFrame:
    """Counts of rows that break the order of a site index: positions below 0, repeated or falling positions
    within a chromosome by row id, gaps in the row ids, and chromosomes with two orders."""
    w = Window.partitionBy("chrom").orderBy("row_id")
    x = index.withColumns({"rise": F.col("pos0") > F.lag("pos0").over(w), "first": F.lag("row_id").over(w).isNull(), "step": F.col("row_id") - F.lag("row_id").over(w)})
    return x.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(_no(F.col("pos0") >= 0)).alias("n_negative"), F.count_if(~F.col("first") & _no(F.col("rise"))).alias("n_unordered"),
        F.count_if(~F.col("first") & (F.col("step") != 1)).alias("n_gaps"), (F.countDistinct("chrom", "chrom_ord") - F.countDistinct("chrom")).alias("n_two_orders"),
    )


def track_violations(obs: DataFrame, n_rows: int, keys: tuple[str, ...] = ("assay", "haplotype", "strand", "sample_id")) -> DataFrame:
    """Per track: cells, cells with a value or coverage out of range, rows off the index, rows that occur twice."""
    cell = obs.groupBy(*keys, "row_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(_no(F.col("value").between(0, VALUE_MAX))).alias("v"), F.count_if(_no(F.col("coverage").between(0, COVERAGE_MAX))).alias("c")
    )
    return cell.groupBy(*keys).agg(
        F.sum("n").alias("n_cells"), F.sum("v").alias("n_bad_value"), F.sum("c").alias("n_bad_coverage"),
        F.count_if(_no(F.col("row_id").between(0, n_rows - 1))).alias("n_off_index"), F.count_if(F.col("n") > 1).alias("n_repeated"),
    )


def refuse(violations: DataFrame, what: str) -> None:
    """Raise if any count but the number of rows is above 0, or there is no row."""
    r = violations.first().asDict()
    if not r["n_rows"] or any(v for k, v in r.items() if k not in ("n_rows", "n_overlapping")):
        raise ValueError(f"not a valid {what}: {r}")
