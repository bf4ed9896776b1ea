"""Queries of this subpackage with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .packing import container_fill, pack_documents
from .percentiles import combined_percentiles, track_percentiles, track_states
from .pii import find_personal_data, redact_documents
from .tokens import encode_corpus
from .topn import top_hotspots


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_hotspots(_read(spark, sf_dir, "strand_hotspot"), _read(spark, sf_dir, "strand_config"))


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_percentiles(_read(spark, sf_dir, "sample_track"))


def p3_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per track over all samples and days, from the daily states."""
    return combined_percentiles([track_states(_read(spark, sf_dir, "sample_track"))])


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_read(spark, sf_dir, "documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pack_profile"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each profile are."""
    return container_fill(p7_containers(spark, sf_dir), _read(spark, sf_dir, "pack_profile"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_read(spark, sf_dir, "documents"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_documents(_read(spark, sf_dir, "documents"))


QUERIES = {
    "p2_found": p2_found,
    "p3_percentiles": p3_percentiles,
    "p3_combined": p3_combined,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}

P2_SQL = r"""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY hotspot_id ORDER BY loaded_at DESC NULLS LAST) AS v FROM strand_hotspot),
d AS (SELECT hotspot_id, run_id, category, lower(regexp_replace(direction, '\s+', '', 'g')) AS direction,
        CASE WHEN NOT isnan(max_hotspot_score) THEN max_hotspot_score END AS score,
        CASE WHEN NOT isnan(max_abs_mean_diff) THEN max_abs_mean_diff END AS diff, n_cpgs FROM v WHERE v = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, category, direction
        ORDER BY score DESC, diff DESC NULLS LAST, n_cpgs DESC NULLS LAST, hotspot_id) AS rank
      FROM d WHERE direction IN ('plus>minus', 'minus>plus') AND score IS NOT NULL),
c AS (SELECT run_id, max(coalesce(top_n_hotspots, 500)) AS n FROM strand_config GROUP BY 1)
SELECT run_id, category, direction, hotspot_id FROM r LEFT JOIN c USING (run_id) WHERE rank <= coalesce(n, 500)
"""

_ONCE = """
o AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY loaded_at NULLS LAST) AS rn
      FROM sample_track) WHERE rn = 1),
l AS (SELECT assay, haplotype, strand, sample_id, loaded_at::DATE AS day, 'value_u16' AS field_name,
        CASE WHEN value_u16 BETWEEN 0 AND 10000 THEN value_u16 END::BIGINT AS v FROM o
      UNION ALL SELECT assay, haplotype, strand, sample_id, loaded_at::DATE, 'coverage',
        CASE WHEN coverage BETWEEN 1 AND 65534 THEN coverage END::BIGINT FROM o)"""


def _ranks(keys: str) -> str:
    cols = ", ".join(f"max(CASE WHEN rn = (n * {p} + 99) // 100 THEN v END) AS p{p:02d}" for p in (5, 25, 50, 75, 95, 99))
    return f"""
WITH {_ONCE},
k AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY v NULLS LAST) AS rn,
        count(v) OVER (PARTITION BY {keys}) AS n FROM l)
SELECT {keys}, max(n) AS n, {cols}, 0 AS rank_error FROM k GROUP BY {keys}"""


ORACLES = {
    "p2_found": P2_SQL,
    "p3_percentiles": _ranks("assay, haplotype, strand, sample_id, day, field_name"),
    "p3_combined": _ranks("assay, haplotype, strand, field_name"),
}
