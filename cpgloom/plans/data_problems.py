"""Queries over the problem tables that belong to the core: p1, p4 and p5, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filling import fill_tracks, filled_cells
from ..operators.intervals import segment_periods
from ..sources.lines import failed_lines, parse_lines


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_periods(_read(spark, sf_dir, "asm_segment"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_cells(_read(spark, sf_dir, "sample_track"))


def p4_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["obs_id", "loaded_at"]
    for c in ("value_u16", "coverage", "platform"):
        cols += [f"{c}_filled", f"{c}_fill_level"]
    return fill_tracks(_read(spark, sf_dir, "sample_track")).select(*cols)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed_lines(_read(spark, sf_dir, "raw_line"))


def p5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid lines, typed."""
    rows = parse_lines(_read(spark, sf_dir, "raw_line"), keep=("line_id", "file_name"))
    return rows.where(F.col("reason").isNull()).drop("reason")


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_filled": p4_filled, "p5_found": p5_found, "p5_rows": p5_rows}

P1_SQL = r"""
WITH c AS (
  SELECT sample_id, chrom_start AS a, chrom_end AS b, lower(regexp_replace(name, '^\s+|\s+$', '', 'g')) AS name,
         regexp_replace(regexp_replace(lower(regexp_replace(chrom, '^\s+|\s+$', '', 'g')), '^chr', ''), '^\s+', '') AS ch
  FROM asm_segment WHERE chrom_end > chrom_start AND trim(sample_id) <> ''),
d AS (SELECT DISTINCT sample_id, 'chr' || CASE WHEN length(ch) = 1 THEN upper(ch) ELSE ch END AS chrom, name, a, b
      FROM c WHERE ch <> '' AND name <> ''),
m AS (SELECT *, max(b) OVER (PARTITION BY sample_id, chrom, name ORDER BY a, b
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END)
                OVER (PARTITION BY sample_id, chrom, name ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM m),
p AS (SELECT sample_id, chrom, name, grp, min(a) AS s, max(b) AS e FROM g GROUP BY ALL),
q AS (SELECT *, lag(e) OVER (PARTITION BY sample_id, chrom, name ORDER BY s) AS pe FROM p)
SELECT 'period' AS kind, sample_id, chrom, name, s AS span_start, e AS span_end FROM q
UNION ALL SELECT 'gap', sample_id, chrom, name, pe, s FROM q WHERE pe IS NOT NULL
"""

_USABLE = r"""
t AS (SELECT *, CASE WHEN value_u16 BETWEEN 0 AND 10000 THEN value_u16 END AS v,
        CASE WHEN coverage BETWEEN 1 AND 65534 THEN coverage END AS c,
        CASE WHEN lower(regexp_replace(platform, '^\s+|\s+$', '', 'g')) IN ('ont', 'pacbio', 'methbat')
             THEN lower(regexp_replace(platform, '^\s+|\s+$', '', 'g')) END AS p
      FROM sample_track)"""

P4_SQL = f"""
WITH {_USABLE},
g AS (SELECT batch_id, row_id, assay, haplotype, strand, count(v) AS nv, count(c) AS nc FROM t GROUP BY ALL),
h AS (SELECT batch_id, sample_id, count(p) AS np FROM t GROUP BY ALL)
SELECT DISTINCT obs_id, 'value_u16' AS field_name FROM t JOIN g USING (batch_id, row_id, assay, haplotype, strand)
  WHERE v IS NULL AND nv > 0
UNION ALL SELECT DISTINCT obs_id, 'coverage' FROM t JOIN g USING (batch_id, row_id, assay, haplotype, strand)
  WHERE c IS NULL AND nc > 0
UNION ALL SELECT DISTINCT obs_id, 'platform' FROM t JOIN h USING (batch_id, sample_id) WHERE p IS NULL AND np > 0
"""

P4_FILLED_SQL = f"""
WITH {_USABLE},
f AS (SELECT batch_id, row_id, assay, haplotype, strand, sample_id, quantile_disc(v, 0.5) AS v1, quantile_disc(c, 0.5) AS c1
      FROM t GROUP BY ALL),
g AS (SELECT batch_id, row_id, assay, haplotype, strand, quantile_disc(v, 0.5) AS v2, quantile_disc(c, 0.5) AS c2
      FROM t GROUP BY ALL),
k AS (SELECT batch_id, sample_id, assay, p, count(*) AS n FROM t WHERE p IS NOT NULL GROUP BY ALL),
k1 AS (SELECT batch_id, sample_id, assay, arg_min(p, (-n, p)) AS p1, sum(n) AS m FROM k GROUP BY ALL),
l AS (SELECT batch_id, sample_id, p, sum(n) AS n FROM k GROUP BY ALL),
l1 AS (SELECT batch_id, sample_id, arg_min(p, (-n, p)) AS p2 FROM l GROUP BY ALL)
SELECT obs_id, loaded_at,
  coalesce(v, v1, v2) AS value_u16_filled,
  CASE WHEN v IS NOT NULL THEN NULL WHEN v1 IS NOT NULL THEN 1 WHEN v2 IS NOT NULL THEN 2 END::INT AS value_u16_fill_level,
  coalesce(c, c1, c2) AS coverage_filled,
  CASE WHEN c IS NOT NULL THEN NULL WHEN c1 IS NOT NULL THEN 1 WHEN c2 IS NOT NULL THEN 2 END::INT AS coverage_fill_level,
  coalesce(p, CASE WHEN m >= 3 THEN p1 END, p2) AS platform_filled,
  CASE WHEN p IS NOT NULL THEN NULL WHEN m >= 3 THEN 1 WHEN p2 IS NOT NULL THEN 2 END::INT AS platform_fill_level
FROM t LEFT JOIN f USING (batch_id, row_id, assay, haplotype, strand, sample_id)
LEFT JOIN g USING (batch_id, row_id, assay, haplotype, strand)
LEFT JOIN k1 USING (batch_id, sample_id, assay) LEFT JOIN l1 USING (batch_id, sample_id)
"""

_FIELD = r'("(?:[^"]|"")*"|[^"\t]*)'
_LINES = rf"""
l AS (SELECT line_id, file_name, file_kind, regexp_replace(line_text, '\r$', '') AS s FROM raw_line
      WHERE line_text IS NULL OR NOT starts_with(line_text, '#')),
q AS (SELECT *, coalesce(regexp_full_match(chr(9) || s, '(\t{_FIELD})*'), true) AS quoted,
        CASE WHEN s = '' OR s IS NULL THEN []
             ELSE list_transform(regexp_extract_all(chr(9) || s, '\t{_FIELD}', 1),
               lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) END AS f
      FROM l),
n AS (SELECT *, len(f) = CASE WHEN file_kind = 'sniffcell_index' THEN 5 ELSE 15 END AS counted, file_kind = 'sniffcell_index' AS sn,
        CASE WHEN regexp_full_match(f[2], '-?[0-9]+') THEN try_cast(f[2] AS BIGINT) END AS a,
        CASE WHEN regexp_full_match(f[3], '-?[0-9]+') THEN try_cast(f[3] AS BIGINT) END AS b,
        CASE WHEN regexp_full_match(f[4], '-?[0-9]+') THEN try_cast(f[4] AS BIGINT) END AS ra,
        CASE WHEN regexp_full_match(f[5], '-?[0-9]+') THEN try_cast(f[5] AS BIGINT) END AS rb,
        CASE WHEN regexp_full_match(f[7], '[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') THEN try_cast(f[7] AS DOUBLE) END AS m,
        CASE WHEN regexp_full_match(f[9], '-?[0-9]+') THEN try_cast(f[9] AS BIGINT) END AS cov
      FROM q),
r AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN NOT counted THEN 'column_count'
        WHEN sn AND coalesce(f[1] <> '' AND 0 <= a AND a < b AND 0 <= ra AND ra < rb, false) THEN NULL
        WHEN NOT sn AND coalesce(f[1] <> '' AND a >= 0 AND b = a + 1 AND m BETWEEN 0 AND 100 AND cov BETWEEN 1 AND 65534
             AND f[8] IN ('Total', 'hap1', 'hap2') AND f[4] = CASE file_kind WHEN 'methbat_5mc' THEN 'm' ELSE 'h' END
             AND CASE file_kind WHEN 'methbat_5mc' THEN f[6] = '.' ELSE f[6] IN ('+', '-') END, false) THEN NULL
        ELSE 'invalid_value' END AS reason FROM n)"""
P5_SQL = f"WITH {_LINES} SELECT line_id, reason FROM r WHERE reason IS NOT NULL"
P5_ROWS_SQL = f"""
WITH {_LINES} SELECT line_id, file_name, f[1] AS chrom, a AS "start", b AS "end", CASE WHEN sn THEN ra END AS source_row_start,
  CASE WHEN sn THEN rb END AS source_row_end, CASE WHEN NOT sn THEN f[4] END AS name, CASE WHEN NOT sn THEN f[6] END AS strand,
  CASE WHEN NOT sn THEN f[8] END AS type, CASE WHEN NOT sn THEN m END AS mod_score, CASE WHEN NOT sn THEN cov END AS cov
FROM r WHERE reason IS NULL"""

ORACLES = {"p1_found": P1_SQL, "p4_found": P4_SQL, "p4_filled": P4_FILLED_SQL, "p5_found": P5_SQL, "p5_rows": P5_ROWS_SQL}
