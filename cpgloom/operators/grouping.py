"""Groups of neighbouring rows: distance units, correlated runs and predefined intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matrix import group_mean  # noqa: F401  (the aggregation that goes with the groups below)
from .ranges import points_in_intervals


def island_ids(rows: DataFrame, breaks: Column, partition: list[str], order: list[str]) -> DataFrame:
    """Gaps and islands: ``run`` counts the breaks so far. A null break, as on a first row, breaks. A
    partition is a chromosome: a few million index rows, whatever the number of samples."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn("run", F.sum(F.coalesce(breaks.cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def groups_of_runs(rows: DataFrame, method: str, min_rows: int = 1) -> DataFrame:
    """Runs to groups: first position to last position + 2, with their half-open row interval; ids count
    the groups that are left, in index order."""
    g = rows.groupBy("chrom", "chrom_ord", "run").agg(
        F.min("pos0").cast("long").alias("start"),
        (F.max("pos0") + 2).cast("long").alias("end"),
        F.min("row_id").alias("source_row_start"),
        (F.max("row_id") + 1).alias("source_row_end"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    g = g.where(F.col("n_rows") >= min_rows)
    return number_groups(g, method).select("group_row", "group_id", "chrom", "start", "end", "source_row_start", "source_row_end", "n_rows")


def number_groups(groups: DataFrame, method: str) -> DataFrame:
    """Add ``group_row`` from 0 and ``group_id`` from 1 in index order (``chrom_ord, source_row_start,
    start``): ranks within a chromosome plus the counts of the chromosomes before it, so no task sees
    all groups."""
    per = groups.groupBy("chrom_ord").agg(F.count(F.lit(1)).alias("k"))
    off = per.withColumn("off", F.coalesce(F.sum("k").over(Window.orderBy("chrom_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("chrom_ord").orderBy("source_row_start", "start", "end"))
    at = F.col("off") + F.col("rank")
    return groups.withColumn("rank", rank).join(F.broadcast(off.select("chrom_ord", "off")), "chrom_ord").withColumns(  # one row per chromosome
        {"group_row": (at - 1).cast("long"), "group_id": F.concat(F.lit(f"{method}_"), at.cast("string"))}
    ).drop("off", "rank")


def distance_groups(index: DataFrame, gap: int = 10, min_rows: int = 1, method: str = "decode") -> DataFrame:
    """A new group begins where the gap to the previous position exceeds ``gap``."""
    prev = F.lag("pos0").over(Window.partitionBy("chrom").orderBy("pos0", "row_id"))
    rows = island_ids(index, (F.col("pos0") - prev) > gap, ["chrom"], ["pos0", "row_id"])
    return groups_of_runs(rows, method, min_rows)


def adjacent_correlation(index: DataFrame, view: DataFrame, min_shared: int = 3) -> DataFrame:
    """Pearson over the samples that both a row and the next row of its chromosome observe; null for
    fewer than ``min_shared`` samples or a constant side. Every cell is sent to the pair of its row and the
    next one and to the pair of the row before; a pair's cells, two per sample at most, meet by one shuffle
    without sorting, and six sums do the rest."""
    w = Window.partitionBy("chrom").orderBy("pos0", "row_id")
    at = index.select("row_id", F.lead("row_id").over(w).alias("next_row"), F.lag("row_id").over(w).alias("prev_row"))
    value = F.col("value").cast("long")
    none = F.lit(None).cast("long")
    both = F.array(
        F.struct(F.when(F.col("next_row").isNotNull(), F.col("row_id")).alias("pair"), value.alias("x"), none.alias("y")),
        F.struct(F.col("prev_row").alias("pair"), none.alias("x"), value.alias("y")),
    )
    sent = view.select("row_id", "sample_id", "value").join(at, "row_id").select("sample_id", F.inline(both)).where(F.col("pair").isNotNull())
    met = sent.repartition("pair").groupBy("pair", "sample_id").agg(F.max("x").alias("x"), F.max("y").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    s = met.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"),
    )
    s = s.join(at.select(F.col("row_id").alias("pair"), "next_row"), "pair").withColumnRenamed("pair", "row_id")
    vx, vy = F.expr("n * sxx - sx * sx"), F.expr("n * syy - sy * sy")
    cov = F.expr("n * sxy - sx * sy").cast("double")
    ok = (F.col("n") >= min_shared) & (vx > 0) & (vy > 0)
    r = F.when(ok, F.round(cov / (F.sqrt(vx.cast("double")) * F.sqrt(vy.cast("double"))), 9))
    return s.select("row_id", "next_row", F.col("n").alias("n_shared"), r.alias("correlation"))


def correlated_groups(
    index: DataFrame, view: DataFrame, min_correlation: float = 0.8, gap: int = 200, min_shared: int = 3, min_rows: int = 2
) -> DataFrame:
    """A row joins the previous one when gap, shared samples and correlation all allow it."""
    link = adjacent_correlation(index, view, min_shared).where(F.col("correlation") >= min_correlation)
    link = link.select(F.col("next_row").alias("row_id"), F.lit(True).alias("linked"))
    prev = F.lag("pos0").over(Window.partitionBy("chrom").orderBy("pos0", "row_id"))
    rows = index.join(link, "row_id", "left").withColumn("d", F.col("pos0") - prev)
    rows = island_ids(rows, ~(F.coalesce("linked", F.lit(False)) & (F.col("d") <= gap)), ["chrom"], ["pos0", "row_id"])
    return groups_of_runs(rows, "denovo", min_rows)


def predefined_groups(index: DataFrame, intervals: DataFrame, left_shift: int = 0, min_rows: int = 1) -> DataFrame:
    """Predefined intervals (``region_id, chrom, start, end``) to the index rows they hold, after moving
    the start left, at 0 at least; intervals without a row are left out. Own bounds and reference bounds
    are both kept."""
    moved = intervals.select("region_id", "chrom", F.greatest(F.col("start") - left_shift, F.lit(0)).cast("long").alias("start"), "end", F.col("start").alias("ref"))
    hit = points_in_intervals(index.select("row_id", "chrom", "pos0"), moved)
    return hit.groupBy("i_region_id", "i_chrom", "i_ref", "i_end").agg(
        F.min("p_pos0").cast("long").alias("start"), (F.max("p_pos0") + 2).cast("long").alias("end"),
        F.min("p_row_id").alias("source_row_start"), (F.max("p_row_id") + 1).alias("source_row_end"), F.count(F.lit(1)).alias("n_rows"),
    ).where(F.col("n_rows") >= min_rows).select(
        F.col("i_region_id").alias("region_id"), F.col("i_chrom").alias("chrom"), "start", "end", "source_row_start", "source_row_end",
        F.col("i_ref").alias("reference_start"), F.col("i_end").alias("reference_end"), "n_rows",
    )


def group_members(groups: DataFrame) -> DataFrame:
    return groups.select("group_row", F.explode(F.expr("sequence(source_row_start, source_row_end - 1)")).alias("row_id"))


def reduction_summary(groups: DataFrame, n_source: int) -> DataFrame:
    g = groups.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("covered_rows"))
    return g.withColumn("reduction", F.lit(float(n_source)) / F.nullif(F.col("n_groups"), F.lit(0)))
