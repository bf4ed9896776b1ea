"""Segment sets: interval union, projection onto regions and support filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import is_finite
from ..session import cut_lineage
from .intervals import periods_and_gaps
from .matrix import each_sample
from .ranges import overlap_join


def merge_intervals(df: DataFrame, gap: int = 0) -> DataFrame:
    """Union of ``chrom, start, end`` of all samples; intervals up to ``gap`` apart merge, touching ones
    at 0. ``region_id`` counts the regions in order of chromosome name and start. The union is made once,
    however often its rows are used."""
    wide = df.select("chrom", "start", (F.col("end") + gap).alias("end")).where(F.col("end") > F.col("start") + gap)
    p = periods_and_gaps(wide, ["chrom"], "start", "end").where("kind = 'period'")
    merged = cut_lineage(p.select("chrom", F.col("span_start").alias("start"), (F.col("span_end") - gap).alias("end")))
    return number_regions(merged)


def number_regions(regions: DataFrame) -> DataFrame:
    """``region_id`` from 1 in order of chromosome name and start: ranks within a chromosome plus the counts
    of those before it, so no task sees all regions."""
    per = regions.groupBy("chrom").agg(F.count(F.lit(1)).alias("k"))
    before = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)  # one row per chromosome
    off = per.select("chrom", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("off"))
    rank = F.row_number().over(Window.partitionBy("chrom").orderBy("start", "end"))
    out = regions.withColumn("rank__", rank).join(F.broadcast(off), "chrom").withColumn("region_id", F.col("off") + F.col("rank__"))
    return out.select("region_id", *[c for c in regions.columns if c != "region_id"])


def drop_sex_chromosomes(regions: DataFrame) -> DataFrame:
    """Regions off the sex chromosomes, numbered anew."""
    return number_regions(regions.where(~F.lower("chrom").isin("x", "y", "chrx", "chry")))


def project_metric(segments: DataFrame, regions: DataFrame, metric: str) -> DataFrame:
    """Overlap-weighted mean of a metric per region and sample; segments without a finite metric do not
    count, regions without a segment have no row."""
    ok = segments.where(is_finite(F.col(metric))).select("sample_id", "chrom", "start", "end", F.col(metric).alias("v"))
    j = overlap_join(ok, regions.select("region_id", "chrom", "start", "end"))
    return j.groupBy(F.col("r_region_id").alias("region_id"), F.col("l_sample_id").alias("sample_id")).agg(
        (F.sum(F.col("l_v") * F.col("overlap")) / F.sum("overlap")).alias("value")
    )


def project_presence(segments: DataFrame, regions: DataFrame, samples: DataFrame) -> DataFrame:
    """1 or 0 for every region and sample: does any segment of the sample overlap it?"""
    j = overlap_join(segments.select("sample_id", "chrom", "start", "end"), regions.select("region_id", "chrom", "start", "end"))
    hit = j.select(F.col("r_region_id").alias("region_id"), F.col("l_sample_id").alias("sample_id")).distinct().withColumn("hit", F.lit(1))
    every = each_sample(regions.select("region_id"), samples)
    return every.join(hit, ["region_id", "sample_id"], "left").select("region_id", "sample_id", F.coalesce("hit", F.lit(0)).cast("int").alias("value"))


def supported_regions(hits: DataFrame, n_samples: int, min_samples: int = 2, min_fraction: float = 0.1) -> DataFrame:
    """Regions that enough samples support (``hits``: one row per supporting region and sample)."""
    n = hits.groupBy("region_id").agg(F.count(F.lit(1)).alias("n_support"))
    return n.where((F.col("n_support") >= min_samples) & (F.col("n_support") / F.lit(float(n_samples)) >= min_fraction))
