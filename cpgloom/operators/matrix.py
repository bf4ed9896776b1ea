"""Masked aggregates over sparse observations.

Observations are rows ``assay, haplotype, strand, sample_id, row_id, value``; an absent row is a missing
cell. The roster (view columns) says which samples a view has, observed or not. Numerators are
integers: sums are exact in any order and rounded once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import VALUE_MAX, decode_fraction, rounded_mean

VIEW = ["assay", "haplotype", "strand"]


def select_view(obs: DataFrame, assay: str, haplotype: str, strand: str) -> DataFrame:
    """One view; the filters reach partition columns or the scan."""
    return obs.where((F.col("assay") == assay) & (F.col("haplotype") == haplotype) & (F.col("strand") == strand)).drop(*VIEW)


def select_tracks(obs: DataFrame, assay: str = "all", haplotype: str = "all", strand: str = "all") -> DataFrame:
    """Selectors are ``all`` or comma lists."""
    for c, wanted in zip(VIEW, (assay, haplotype, strand)):
        if wanted.strip().lower() != "all":
            obs = obs.where(F.col(c).isin([w.strip() for w in wanted.split(",") if w.strip()]))
    return obs


def roster(obs: DataFrame) -> DataFrame:
    return obs.select(*VIEW, "sample_id").distinct()


#: A roster is dealt into arrays of up to this many samples (some 20 bytes each).
ROSTER_LIMIT = 200_000


def each_sample(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Every row once per sample of a roster, for results that are dense by definition. The roster travels as
    arrays of at most about ``ROSTER_LIMIT`` samples, to which the rows are joined by number; a single array is
    broadcast."""
    parts = -(-samples.count() // ROSTER_LIMIT) or 1
    arrays = samples.groupBy(F.pmod(F.xxhash64("sample_id"), F.lit(parts)).cast("int").alias("part__")).agg(F.sort_array(F.collect_set("sample_id")).alias("sample_ids"))
    numbered = rows.withColumn("part__", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return numbered.join(F.broadcast(arrays) if parts == 1 else arrays, "part__").select(*rows.columns, F.explode("sample_ids").alias("sample_id"))


def range_dense(index: DataFrame, view: DataFrame, sample_id: str, chrom: str, start: int, end: int) -> DataFrame:
    """Every index row of ``[start, end)``; a missing cell has a null fraction."""
    rows = index.where((F.col("chrom") == chrom) & F.col("pos0").between(start, end - 1))
    cells = view.where(F.col("sample_id") == sample_id).select("row_id", "value")
    return rows.join(cells, "row_id", "left").select("row_id", "chrom", "pos0", decode_fraction(F.col("value")).alias("fraction"))


def range_observed(index: DataFrame, view: DataFrame, sample_id: str, chrom: str, start: int, end: int) -> DataFrame:
    return range_dense(index, view, sample_id, chrom, start, end).where(F.col("fraction").isNotNull())


def merge_modified(obs: DataFrame, parts: tuple[str, str] = ("5mC", "5hmC"), merged: str = "modifiedC", keep: tuple[str, ...] = ()) -> DataFrame:
    """Sum of both assays, at most 1, where both are observed, else the observed one; combined only
    within equal haplotype and strand. ``keep`` are columns that depend on the row."""
    both = obs.where(F.col("assay").isin(*parts))
    return both.groupBy("haplotype", "strand", "sample_id", "row_id", *keep).agg(
        F.least(F.sum("value"), F.lit(VALUE_MAX)).cast("int").alias("value")
    ).select(F.lit(merged).alias("assay"), "haplotype", "strand", "sample_id", "row_id", *keep, "value")


def observed_counts(obs: DataFrame, columns: DataFrame) -> DataFrame:
    """Observed cells per view and sample of the roster, 0 for none."""
    n = obs.groupBy(*VIEW, "sample_id").agg(F.count(F.lit(1)).alias("n_observed"))
    return columns.select(*VIEW, "sample_id").join(n, [*VIEW, "sample_id"], "left").withColumn("n_observed", F.coalesce("n_observed", F.lit(0)))


def track_summary(counts: DataFrame, n_rows: int) -> DataFrame:
    frac = F.col("n_observed") / F.lit(float(n_rows))
    return counts.groupBy(*VIEW).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(F.col("n_observed") > 0).alias("n_with_data"),
        F.avg("n_observed").alias("mean_observed"),
        F.percentile("n_observed", 0.5).alias("median_observed"),
        F.min("n_observed").alias("min_observed"),
        F.max("n_observed").alias("max_observed"),
        F.avg(frac).alias("mean_fraction"),
        F.percentile(frac, 0.5).alias("median_fraction"),
    )


def sample_rank(counts: DataFrame) -> DataFrame:
    """Rank of samples within their view: most observed first, then by name."""
    w = Window.partitionBy(*VIEW).orderBy(F.col("n_observed").desc(), "sample_id")
    return counts.withColumn("rank", F.row_number().over(w).cast("long"))


def metadata_group_summary(counts: DataFrame, meta: DataFrame, fields: list[str]) -> DataFrame:
    """Observed counts per view and metadata value; a null value is ``NA``, a blank one is left out, and
    so is a field with fewer than two values."""
    long = meta.select("sample_id", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.coalesce(F.trim(F.col(f).cast("string")), F.lit("NA")).alias("value")) for f in fields
    ])).alias("x")).select("sample_id", "x.*").where(F.col("value") != "")
    g = counts.join(long, "sample_id").groupBy(*VIEW, "field", "value").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("n_observed").alias("n_observed")
    )
    kinds = long.groupBy("field").agg(F.countDistinct("value").alias("k")).where("k >= 2")
    return g.join(F.broadcast(kinds.select("field")), "field")  # at most one row per field


#: A map of rows to groups of up to this many rows (16 bytes each, some 100 in a hash table) is broadcast.
BROADCAST_MEMBERS = 1_000_000


def group_mean(obs: DataFrame, members: DataFrame, min_observed: int = 1) -> DataFrame:
    """Mean per group and sample over the observed member rows; ``members`` maps row_id to group_row,
    and a row belongs to one group at most. A small map (counted) is broadcast, so that cells are added up
    where they lie before they are shuffled."""
    of = members.select("row_id", "group_row")
    return (
        obs.join(F.broadcast(of) if of.count() <= BROADCAST_MEMBERS else of, "row_id")
        .groupBy(*VIEW, "group_row", "sample_id")
        .agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n_observed"))
        .where(F.col("n_observed") >= min_observed)
        .select(*VIEW, "group_row", "sample_id", rounded_mean(F.col("s"), F.col("n_observed")).alias("value"), "n_observed")
    )


def region_mean(view: DataFrame, row_regions: DataFrame) -> DataFrame:
    """Mean observed fraction per region and sample; a row counts in each region that holds it."""
    return view.join(row_regions.select("row_id", "region_id"), "row_id").groupBy("region_id", "sample_id").agg(
        (F.sum("value") / F.count(F.lit(1)) / F.lit(float(VALUE_MAX))).alias("fraction"), F.count(F.lit(1)).alias("n_observed")
    )


def region_table(view: DataFrame, row_regions: DataFrame, regions: DataFrame) -> DataFrame:
    """``region_id, chrom, start, end, n_cpgs, sample_id, fraction``: region means beside the number of index
    rows of the region, observed or not. A region that no sample observes has one row with null sample."""
    n = row_regions.groupBy("region_id").agg(F.count(F.lit(1)).alias("n_cpgs"))
    m = region_mean(view, row_regions).select("region_id", "sample_id", "fraction")
    return regions.select("region_id", "chrom", "start", "end").join(n, "region_id", "left").join(m, "region_id", "left").withColumn("n_cpgs", F.coalesce("n_cpgs", F.lit(0)))


def bin_mean(obs: DataFrame, index: DataFrame, width: int) -> DataFrame:
    """Mean per view, sample and fixed bin of ``width`` bases; empty bins are absent."""
    placed = obs.join(index.select("row_id", "chrom", F.expr(f"pos0 div {width}").alias("bin")), "row_id")
    return placed.groupBy(*VIEW, "sample_id", "chrom", "bin").agg(
        rounded_mean(F.sum("value"), F.count(F.lit(1))).alias("value"), F.count(F.lit(1)).alias("n_observed")
    )


def group_bin_mean(bins: DataFrame, columns: DataFrame, meta: DataFrame, field: str) -> DataFrame:
    """Mean over a metadata group's samples of their bin means; ``n_samples`` is the group's size in the
    view's roster, observed or not."""
    label = meta.select("sample_id", F.trim(F.col(field)).alias("label")).where("label <> ''").distinct()
    size = columns.join(label, "sample_id").groupBy(*VIEW, "label").agg(F.count(F.lit(1)).alias("n_samples"))
    g = bins.join(label, "sample_id").groupBy(*VIEW, "label", "chrom", "bin").agg(
        (F.sum("value") / F.count(F.lit(1)) / F.lit(float(VALUE_MAX))).alias("fraction")
    )
    return g.join(size, [*VIEW, "label"])


def presence_rows(view: DataFrame, n_samples: int, min_fraction: float) -> DataFrame:
    """Rows observed in at least this fraction of the roster."""
    n = view.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_observed"))
    return n.where(F.col("n_observed") / F.lit(float(n_samples)) >= min_fraction)


def sample_rows(rows: DataFrame, fraction: float, seed: int = 1) -> DataFrame:
    """A seeded sample without replacement, the same each time: the rows of smallest hash."""
    n = rows.count()
    return rows.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(max(int(n * fraction), 1) if n else 0)


def moments(view: DataFrame, rows: DataFrame) -> DataFrame:
    """Mean and sample deviation of each sample's fractions over ``rows``; at most one value gives 0 and
    1, a zero deviation counts as 1."""
    m = view.join(rows.select("row_id"), "row_id").groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("long")).alias("s"), F.sum(F.col("value").cast("long") * F.col("value")).alias("q")
    )
    var = (F.col("q") - F.col("s").cast("double") * F.col("s") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    std = F.sqrt(F.greatest(var, F.lit(0.0))) / VALUE_MAX
    many = F.col("n") > 1
    return m.select(
        "sample_id",
        "n",
        F.when(many, F.col("s") / F.col("n") / VALUE_MAX).otherwise(F.lit(0.0)).alias("mean"),
        F.when(many & (std > 0), std).otherwise(F.lit(1.0)).alias("std"),
    )


def combine_tracks(obs: DataFrame, how: str) -> DataFrame:
    """Sum (not capped) or mean across the tracks of a row and sample, over observed ones."""
    if how not in ("sum", "mean"):
        raise ValueError(how)
    total, n = F.sum("value"), F.count(F.lit(1))
    out = total / F.lit(float(VALUE_MAX)) if how == "sum" else total / n / F.lit(float(VALUE_MAX))
    return obs.groupBy("row_id", "sample_id").agg(out.alias("fraction"))


def sliding_mean(points: DataFrame, k: int, min_points: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Trailing mean over exactly k observed points of each track and sample, within the keys ``by`` (position and fraction);
    series with fewer than k or ``min_points`` points, and k below 2, stay as they are."""
    key = Window.partitionBy(*VIEW, "sample_id", *by)
    w = key.orderBy("pos0", "row_id")
    run = w.rowsBetween(-(k - 1), 0)
    x = points.withColumns({"m": F.count(F.lit(1)).over(key), "i": F.row_number().over(w)})
    raw = (F.col("m") < max(k, min_points)) | F.lit(k < 2)
    smooth = x.withColumns({"px": F.avg("pos0").over(run), "pv": F.sum("value").over(run) / F.count(F.lit(1)).over(run) / VALUE_MAX})
    return smooth.where(raw | (F.col("i") >= k)).select(
        *VIEW, "sample_id", *by, F.when(raw, F.col("pos0").cast("double")).otherwise(F.col("px")).alias("pos0_mean"),
        F.when(raw, F.col("value") / F.lit(float(VALUE_MAX))).otherwise(F.col("pv")).alias("fraction"),
    )


def common_samples(columns: DataFrame, n_views: int) -> DataFrame:
    """Samples that every one of the selected views has."""
    return columns.groupBy("sample_id").agg(F.countDistinct(*VIEW).alias("k")).where(F.col("k") == n_views).select("sample_id")


def duplicate_samples(columns: DataFrame) -> DataFrame:
    return columns.groupBy(*VIEW, "sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def resolve_aliases(columns: DataFrame, alias_columns: list[str]) -> DataFrame:
    """Alias to sample; an alias that names several samples is left out."""
    long = columns.select("sample_id", F.explode(F.array(*[F.col(c).cast("string") for c in alias_columns])).alias("alias"))
    return long.where("alias <> ''").groupBy("alias").agg(F.countDistinct("sample_id").alias("k"), F.min("sample_id").alias("sample_id")).where("k = 1").drop("k")
