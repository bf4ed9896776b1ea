"""Paired-strand scores, hotspot clusters and their profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matrix import each_sample

MAX = 10000.0


def paired(obs: DataFrame) -> DataFrame:
    """Cells observed on both strands: ``row_id, sample_id, p, m`` by one aggregation, no join."""
    both = obs.where(F.col("strand").isin("plus", "minus")).groupBy("row_id", "sample_id").agg(
        F.max(F.when(F.col("strand") == "plus", F.col("value"))).alias("p"), F.max(F.when(F.col("strand") == "minus", F.col("value"))).alias("m")
    )
    return both.where(F.col("p").isNotNull() & F.col("m").isNotNull())


def _score(df: DataFrame, keys: list[str]) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_paired"), F.sum("p").alias("sp"), F.sum("m").alias("sm"))
    diff = (F.col("sp") - F.col("sm")) / F.col("n_paired") / MAX
    return g.select(
        *keys, "n_paired", (F.col("sp") / F.col("n_paired") / MAX).alias("mean_plus"), (F.col("sm") / F.col("n_paired") / MAX).alias("mean_minus"),
        diff.alias("mean_diff"), F.abs(diff).alias("abs_mean_diff"), ((F.col("sp") + F.col("sm")) / (2 * F.col("n_paired")) / MAX).alias("mean_total"),
        (F.abs(diff) * F.sqrt(F.col("n_paired").cast("double"))).alias("score"),
        F.when(F.col("sp") >= F.col("sm"), "plus>minus").otherwise("minus>plus").alias("direction"),
    )


def strand_scores(pairs: DataFrame, min_paired: int, min_total: float = 0.0) -> DataFrame:
    return _score(pairs, ["row_id"]).where((F.col("n_paired") >= min_paired) & (F.col("mean_total") >= min_total))


def category_scores(pairs: DataFrame, category: DataFrame, fraction: float, min_total: float = 0.0) -> DataFrame:
    """Scores within the samples of a category (``sample_id, category``); a row needs pairs in
    max(1, ceil(samples * fraction)) of them."""
    size = category.groupBy("category").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * fraction)).alias("need"))
    s = _score(pairs.join(category, "sample_id"), ["category", "row_id"]).join(size, "category")
    return s.where((F.col("n_paired") >= F.col("need")) & (F.col("mean_total") >= min_total)).drop("need")


def sample_metrics(pairs: DataFrame) -> DataFrame:
    g = pairs.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_paired"), F.sum("p").alias("sp"), F.sum("m").alias("sm"))
    return g.select(
        "sample_id", "n_paired", (F.col("sp") / F.col("n_paired") / MAX).alias("mean_plus"), (F.col("sm") / F.col("n_paired") / MAX).alias("mean_minus"),
        ((F.col("sp") - F.col("sm")) / F.col("n_paired") / MAX).alias("mean_diff"),
        ((F.col("sp") - F.col("sm")) / F.nullif(F.col("sp") + F.col("sm"), F.lit(0))).alias("balance"),
    )


def category_summary(metrics: DataFrame, category: DataFrame) -> DataFrame:
    return metrics.join(category, "sample_id").groupBy("category").agg(
        F.countDistinct("sample_id").alias("n_samples"), F.percentile("mean_diff", 0.5).alias("median_diff"), F.avg("mean_diff").alias("mean_diff"),
        F.percentile("balance", 0.5).alias("median_balance"),
    )


def candidate_limit(top_n: int, min_cluster: int) -> int:
    return top_n * max(5, 20 * min_cluster)


def best_rows(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows: score, then difference, then position."""
    return scores.orderBy(F.col("score").desc(), F.col("abs_mean_diff").desc(), "row_id").limit(k)


def best_category_rows(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows of each category, in the same order."""
    w = Window.partitionBy("category").orderBy(F.col("score").desc(), F.col("abs_mean_diff").desc(), "row_id")
    return scores.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).drop("nth")


def hotspot_clusters(rows: DataFrame, index: DataFrame, gap: int, min_cpgs: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Neighbouring rows of one chromosome and direction with gaps up to ``gap``, within the keys ``by``; the
    representative is the row of the highest score, the first on ties. Also numbers each cluster as ``run``."""
    at = rows.join(index.select("row_id", "chrom", "pos0"), "row_id")
    w = Window.partitionBy(*by, "chrom").orderBy("pos0", "row_id")
    new = ((F.col("pos0") - F.lag("pos0").over(w)) > gap) | (F.col("direction") != F.lag("direction").over(w))
    runs = at.withColumn("new", F.coalesce(new.cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "chrom", "run", "direction").agg(
        F.min("pos0").cast("long").alias("cluster_start"), (F.max("pos0") + 1).cast("long").alias("cluster_end"), F.count(F.lit(1)).alias("n_cpgs"),
        F.max("score").alias("max_score"), F.max("abs_mean_diff").alias("max_abs_mean_diff"),
        F.min_by("row_id", F.struct((-F.col("score")).alias("s"), F.col("pos0"), F.col("row_id"))).alias("representative_row_id"),
    ).where(F.col("n_cpgs") >= min_cpgs)


def ranked_clusters(clusters: DataFrame, top_n: int, by: tuple[str, ...] = ()) -> DataFrame:
    order = [F.col("max_score").desc(), F.col("max_abs_mean_diff").desc(), F.col("n_cpgs").desc(), F.col("chrom"), F.col("cluster_start")]
    if by:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
        return clusters.withColumn("rank", rank).where(F.col("rank") <= top_n)
    best = clusters.orderBy(*order).limit(top_n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))  # top_n rows


def hotspot_profiles(pairs: DataFrame, clusters: DataFrame, category: DataFrame) -> DataFrame:
    """Per representative row and category: samples with pairs, means, median difference."""
    rep = clusters.select(F.col("representative_row_id").alias("row_id"))
    x = pairs.join(rep, "row_id", "left_semi").join(category, "sample_id")
    return x.groupBy("row_id", "category").agg(
        F.count(F.lit(1)).alias("n_samples"), (F.sum("p") / F.count(F.lit(1)) / MAX).alias("mean_plus"), (F.sum("m") / F.count(F.lit(1)) / MAX).alias("mean_minus"),
        F.percentile((F.col("p") - F.col("m")) / MAX, 0.5).alias("median_diff"),
    )


def sample_profiles(obs: DataFrame, clusters: DataFrame, samples: DataFrame) -> DataFrame:
    """Per representative row and sample of the roster, paired or not: both strands' fractions and their
    difference, null where a strand is missing."""
    rep = clusters.select(F.col("representative_row_id").alias("row_id"), "rank")
    one = obs.where(F.col("strand").isin("plus", "minus")).join(rep, "row_id", "left_semi").groupBy("row_id", "sample_id").agg(
        F.max(F.when(F.col("strand") == "plus", F.col("value"))).alias("p"), F.max(F.when(F.col("strand") == "minus", F.col("value"))).alias("m")
    )
    return each_sample(rep, samples).join(one, ["row_id", "sample_id"], "left").select(
        "row_id", "rank", "sample_id", (F.col("p") / MAX).alias("plus_value"), (F.col("m") / MAX).alias("minus_value"),
        ((F.col("p") - F.col("m")) / MAX).alias("diff_value"), (F.col("p").isNotNull() & F.col("m").isNotNull()).alias("is_paired"),
    )


def direction_of(diff: Column) -> Column:
    return F.when(diff >= 0, "plus>minus").otherwise("minus>plus")
