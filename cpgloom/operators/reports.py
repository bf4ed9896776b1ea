"""What reports show: grouped profiles, group rows of heatmaps, default choices, outlier tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matrix import VALUE_MAX, VIEW, sliding_mean
from .metadata import category_columns

#: Fixed: samples from which groups are shown instead of samples, and rows that a hotspot heatmap shows.
GROUP_MODE_SAMPLES = 60
HEATMAP_ROWS = 80
SAMPLE_COLUMNS = ("display_id", "sample_name")
#: Fixed: columns that colour a report, in order of preference.
COLOR_COLUMNS = ("display_id", "sample_name", "tissue_name", "tissue_broad", "platform", "sex", "preservation", "technology", "center")


def group_row_means(points: DataFrame, category: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``<view>, category, <by>, row_id, pos0, value``: mean over the observed samples of a category at each row.
    ``category`` has ``sample_id, category``; samples without one, or with a blank one, form ``NA``."""
    label = category.select("sample_id", F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("NA")).alias("category"))
    x = points.join(label, "sample_id", "left").withColumn("category", F.coalesce("category", F.lit("NA")))
    return x.groupBy(*VIEW, "category", *by, "row_id", "pos0").agg((F.sum("value") / F.count(F.lit(1))).alias("value"))


def grouped_profile(points: DataFrame, category: DataFrame, k: int, min_points: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Profiles of categories: samples are averaged at each row before smoothing. Positions are 1-based,
    values percent."""
    means = group_row_means(points, category, by).withColumnRenamed("category", "sample_id")
    s = sliding_mean(means, k, min_points, by)
    return s.select(*VIEW, F.col("sample_id").alias("category"), *by, (F.col("pos0_mean") + 1).alias("position"), (F.col("fraction") * 100).alias("percent"))


def profile_table(smoothed: DataFrame, meta: DataFrame) -> DataFrame:
    """Smoothed sample profiles with both coordinates, both units and the samples' metadata."""
    s = smoothed.select(*VIEW, "sample_id", F.col("pos0_mean").alias("x_pos0_mean"), (F.col("pos0_mean") + 1).alias("x_pos1_mean"), "fraction", (F.col("fraction") * 100).alias("percent"))
    return s.join(meta, "sample_id", "left")


def heatmap_groups(bins: DataFrame, category: DataFrame) -> DataFrame:
    """Group rows of a bin heatmap: mean fraction over the samples of a category that the bin observes.
    Blank categories are left out; ``label`` carries the size of the category."""
    label = category.select("sample_id", F.trim("category").alias("category")).where("category <> ''").distinct()
    size = label.groupBy("category").agg(F.count(F.lit(1)).alias("n_samples"))
    g = bins.join(label, "sample_id").groupBy(*VIEW, "category", "chrom", "bin").agg((F.sum("value") / F.count(F.lit(1)) / F.lit(float(VALUE_MAX))).alias("fraction"))
    return g.join(size, "category").select(*VIEW, F.concat("category", F.lit(" (n="), F.col("n_samples").cast("string"), F.lit(")")).alias("label"), "chrom", "bin", "fraction")


def color_columns(meta: DataFrame) -> list[str]:
    """Columns a report can be coloured by: the usual ones that are there, then others with few values."""
    usual = [c for c in COLOR_COLUMNS if c in meta.columns]
    return usual + [c for c in category_columns(meta, ("sample_id", "sample_root")) if c not in usual]


def default_color(meta: DataFrame, wanted: str | None = None) -> str:
    if wanted:
        if wanted not in meta.columns:
            raise ValueError(f"the metadata has no column {wanted!r}")
        return wanted
    return next((c for c in color_columns(meta) if c not in SAMPLE_COLUMNS), "display_id" if "display_id" in meta.columns else "sample_name")


def series_mode(meta: DataFrame, color: str) -> str:
    """``groups`` for many samples whose colour column has at least two values, else ``samples``."""
    if color in SAMPLE_COLUMNS or color not in meta.columns:
        return "samples"
    r = meta.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.nullif(F.trim(F.col(color).cast("string")), F.lit(""))).alias("k")).first()
    return "groups" if r["n"] >= GROUP_MODE_SAMPLES and r["k"] >= 2 else "samples"


def color_map(meta: DataFrame, column: str, n_colors: int) -> DataFrame:
    """``value, color``: values in order take the colours in turn, so a value keeps its colour from report to
    report with the same values. Missing values are ``NA``."""
    v = meta.select(F.coalesce(F.col(column).cast("string"), F.lit("NA")).alias("value")).distinct()
    return v.withColumn("color", ((F.row_number().over(Window.orderBy("value")) - 1) % n_colors).cast("int"))  # values of one category


def pick_hue(columns: list[str], meta_columns: list[str] | None, mode: str | None = None, wanted: str | None = None) -> str | None:
    """The column that colours a pair plot: by metadata (the wanted or first usable one), by sample, or none."""
    mode = mode or ("sample" if meta_columns is None else "metadata")
    if mode == "none":
        return None
    if mode == "metadata" and meta_columns is not None:
        if wanted and wanted in columns:
            return wanted
        return next((c for c in meta_columns if c in columns and c not in ("id", "path", "matrix_key", "matrix_path", "n_obs_cpgs_for_fit")), "id")
    return "id" if mode in ("sample", "metadata") else None


def outlier_tables(embedding: DataFrame) -> dict[str, DataFrame]:
    """Of ``sample_id, ..., distance, is_outlier``: all rows, the outliers by falling distance, the others."""
    return {
        "outlier_report": embedding,
        "outliers_only": embedding.where("is_outlier").orderBy(F.col("distance").desc(), "sample_id"),
        "inliers": embedding.where("NOT is_outlier"),
    }


def bias_ranks(metrics: DataFrame) -> DataFrame:
    """Samples by rising strand difference, ranked from 1."""
    return metrics.withColumn("sample_rank", F.row_number().over(Window.orderBy("mean_diff", "sample_id")).cast("long"))  # one row per sample


def heatmap_rows(profiles: DataFrame, most: int = HEATMAP_ROWS) -> DataFrame:
    """Profiles of the ``most`` best hotspots; ``rank`` numbers all from 1."""
    return profiles.where(F.col("rank") <= most)
