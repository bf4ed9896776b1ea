"""The test tables as the engine's index, observations, segments and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import normal_chrom, normal_name

MIN_COVERAGE = 5


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "cpg_index")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable, covered cells; of several for one cell the largest value."""
    t = read(spark, sf_dir, "sample_track")
    ok = t.where(F.col("value_u16").between(0, 10000) & F.col("coverage").between(MIN_COVERAGE, 65534))
    return ok.groupBy("assay", "haplotype", "strand", "sample_id", "row_id").agg(F.max("value_u16").alias("value"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "asm_segment")
    return (
        t.where((F.col("chrom_end") > F.col("chrom_start")) & F.col("sample_id").isNotNull())
        .select(
            "sample_id", normal_chrom(F.col("chrom")).alias("chrom"), F.col("chrom_start").alias("start"), F.col("chrom_end").alias("end"),
            normal_name(F.col("name")).alias("name"), "effect_size",
        )
        .where(F.col("chrom").isNotNull())
        .distinct()
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample: the first tissue and sex in order of spelling."""
    t = read(spark, sf_dir, "sample_meta").where(F.col("sample_id").isNotNull())
    return t.groupBy("sample_id").agg(F.min(F.lower(F.trim("tissue_name"))).alias("tissue"), F.min("sex").alias("sex"), F.min("donor").alias("donor"))


OBS = f"""obs AS (SELECT assay, haplotype, strand, sample_id, row_id, max(value_u16) AS value FROM sample_track
  WHERE value_u16 BETWEEN 0 AND 10000 AND coverage BETWEEN {MIN_COVERAGE} AND 65534 GROUP BY ALL)"""
SEG = r"""seg AS (SELECT DISTINCT sample_id, 'chr' || CASE WHEN length(ch) <= 1 THEN upper(ch) ELSE ch END AS chrom, chrom_start AS s,
    chrom_end AS e, nullif(lower(regexp_replace(name, '^\s+|\s+$', '', 'g')), '') AS name, effect_size
  FROM (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(chrom, '^\s+|\s+$', '', 'g')), '^chr', ''), '^\s+', '') AS ch FROM asm_segment)
  WHERE chrom_end > chrom_start AND sample_id IS NOT NULL AND ch <> '')"""
META = """meta AS (SELECT sample_id, min(lower(trim(tissue_name))) AS tissue, min(sex) AS sex, min(donor) AS donor FROM sample_meta
  WHERE sample_id IS NOT NULL GROUP BY 1)"""
