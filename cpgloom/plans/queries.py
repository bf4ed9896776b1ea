"""The engine's operators as queries over the test tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import embed, export, grouping, matrix, metadata, ranges, segments, strand
from ..session import cut_lineage, keep
from ..sources import beds, fasta
from . import adapters as A
from .adapters import META, OBS, SEG

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEW = matrix.VIEW
V5 = ("5mC", "combined", "combined")
C5 = "assay = '5mC' AND haplotype = 'combined' AND strand = 'combined'"
CTRL = "MBCTRL01"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _view(s, d):
    return matrix.select_view(A.observations(s, d), *V5)


def _samples(view: DataFrame) -> DataFrame:
    return view.select("sample_id").distinct()


# ------------------------------------------------------------------ index, codec, ingestion steps


@query("SELECT row_number() OVER (ORDER BY chrom_ord, pos0) - 1 AS row_id, chrom, pos0 FROM cpg_index")
def index_rows(s, d):
    """Dense row ids in index order from (chrom_ord, pos0): counted per chromosome, then offset."""
    return fasta.number_sites(A.index(s, d).select("chrom", "chrom_ord", "pos0")).select("row_id", "chrom", "pos0")


@query("""WITH p AS (SELECT doc_id, string_split(text, 'ch') AS parts FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM p)
SELECT doc_id, pos0::BIGINT AS pos0 FROM (SELECT doc_id, i, n, sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY i) - 2 AS pos0 FROM x) WHERE i < n""")
def motif_in_texts(s, d):
    return fasta.motif_positions(A.read(s, d, "documents"), "doc_id", "text", "ch")


@query("""SELECT obs_id, loaded_at, CASE WHEN value_u16::FLOAT / 100 BETWEEN 0 AND 100 THEN round_even((value_u16::FLOAT / 100::FLOAT)::FLOAT * 100::FLOAT, 0)::INT END AS encoded,
CASE WHEN value_u16 BETWEEN 0 AND 10000 THEN value_u16 / 10000.0::DOUBLE END AS fraction FROM sample_track""")
def encode_decode(s, d):
    t = A.read(s, d, "sample_track")
    pct = F.col("value_u16").cast("float") / F.lit(100).cast("float")
    v = F.when(F.col("value_u16").between(0, 10000), F.col("value_u16"))
    return t.select("obs_id", "loaded_at", codec.encode_percent(pct.cast("float")).alias("encoded"), codec.decode_fraction(v).alias("fraction"))


@query("""WITH t AS (SELECT s.*, i.row_id AS hit FROM sample_track s LEFT JOIN cpg_index i ON s.row_id = i.row_id AND i.chrom <> 'chrX')
SELECT assay, haplotype, strand, count(*) AS n_input, count_if(coverage IS NULL OR coverage < 5) AS n_below,
count_if(coverage >= 5 AND hit IS NULL) AS n_off_index, count_if(coverage >= 5 AND hit IS NOT NULL) AS n_imported FROM t GROUP BY ALL""")
def import_receipt(s, d):
    """Rows in, below coverage, off the index (here without chrX), imported."""
    idx = A.index(s, d).where("chrom <> 'chrX'").select(F.col("row_id").alias("hit"))
    t = A.read(s, d, "sample_track").select(*VIEW, "row_id", "coverage")
    return beds.import_receipt(t.join(idx, F.col("row_id") == F.col("hit"), "left").select(*VIEW, F.col("hit").alias("row_id"), "coverage"), A.MIN_COVERAGE)


@query(f"""WITH {OBS}, c AS (SELECT o.*, i.chrom, CASE WHEN strand = 'minus' THEN greatest(pos0 - 10400, 0) ELSE pos0 END AS p FROM obs o JOIN cpg_index i USING (row_id))
SELECT chrom, strand, count(*) AS n, sum(p)::BIGINT AS total FROM c GROUP BY ALL""")
def minus_shift(s, d):
    """The minus-strand shift, clamped at 0 (positions are moved down first, so that some clamp)."""
    x = A.observations(s, d).join(A.index(s, d).select("row_id", "chrom", "pos0"), "row_id")
    st = F.when(F.col("strand") == "minus", "-").otherwise("+")
    base = F.when(F.col("strand") == "minus", F.col("pos0") - 10399).otherwise(F.col("pos0"))
    p = codec.shift_minus(base, st, clamp=True)
    return x.groupBy("chrom", "strand").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("total"))


# ------------------------------------------------------------------ lookups and rosters


@query(f"""WITH {OBS} SELECT i.row_id, i.chrom, i.pos0, o.value / 10000.0::DOUBLE AS fraction FROM cpg_index i
LEFT JOIN (SELECT * FROM obs WHERE {C5} AND sample_id = '{CTRL}') o USING (row_id) WHERE i.chrom = 'chr1' AND i.pos0 BETWEEN 10000 AND 1500000""")
def range_query_dense(s, d):
    r = codec.parse_inclusive_region("chr1:10000-1500000")
    return matrix.range_dense(A.index(s, d), _view(s, d), CTRL, r.chrom, r.start, r.end)


@query(f"""WITH {OBS} SELECT i.row_id, i.chrom, i.pos0, o.value / 10000.0::DOUBLE AS fraction FROM cpg_index i
JOIN (SELECT * FROM obs WHERE {C5} AND sample_id = '{CTRL}') o USING (row_id) WHERE i.chrom = 'chr1' AND i.pos0 BETWEEN 10000 AND 1500000""")
def range_query_observed(s, d):
    return matrix.range_observed(A.index(s, d), _view(s, d), CTRL, "chr1", 10000, 1500001)


@query(f"""WITH {OBS} SELECT i.row_id, i.chrom, i.pos0, o.value / 10000.0::DOUBLE AS fraction FROM cpg_index i
LEFT JOIN (SELECT * FROM obs WHERE {C5} AND sample_id = '{CTRL}') o USING (row_id) WHERE i.chrom = 'chr1' AND i.pos0 = 10097""")
def point_query(s, d):
    r = codec.parse_locus("chr1:10097")
    return matrix.range_dense(A.index(s, d), _view(s, d), CTRL, r.chrom, r.start, r.end)


@query(f"WITH {OBS} SELECT assay || '__' || haplotype || '__' || strand AS view_name, count(*) AS n_cells, count(DISTINCT sample_id) AS n_samples FROM obs WHERE assay IN ('5mC', '5hmC') AND strand IN ('plus', 'minus') GROUP BY 1")
def select_views(s, d):
    x = matrix.select_tracks(A.observations(s, d), "5mC,5hmC", "all", "plus,minus")
    return x.groupBy(codec.view_name(*[F.col(c) for c in VIEW]).alias("view_name")).agg(F.count(F.lit(1)).alias("n_cells"), F.countDistinct("sample_id").alias("n_samples"))


def _batches(s, d):
    t = A.read(s, d, "sample_track").where(F.col("value_u16").between(0, 10000) & F.col("coverage").between(5, 65534))
    half = F.col("batch_id") % 2
    cols = [*VIEW, "sample_id"]
    return t.where(half == 0).select(*cols).distinct(), t.where(half == 1).select(*cols).distinct()


@query("""WITH t AS (SELECT DISTINCT assay, haplotype, strand, sample_id, batch_id % 2 AS h FROM sample_track WHERE value_u16 BETWEEN 0 AND 10000 AND coverage BETWEEN 5 AND 65534)
SELECT assay, haplotype, strand, sample_id, count(*) AS n FROM t GROUP BY ALL HAVING count(*) > 1""")
def duplicate_samples(s, d):
    """Samples that two batches of imports both bring into a view."""
    a, b = _batches(s, d)
    return matrix.duplicate_samples(a.unionByName(b))


@query("""WITH t AS (SELECT DISTINCT assay, haplotype, strand, sample_id, batch_id % 2 AS h FROM sample_track WHERE value_u16 BETWEEN 0 AND 10000 AND coverage BETWEEN 5 AND 65534),
f AS (SELECT assay, haplotype, strand, sample_id, min(h) AS h FROM t GROUP BY ALL)
SELECT assay, haplotype, strand, sample_id, row_number() OVER (PARTITION BY assay, haplotype, strand ORDER BY h, sample_id) - 1 AS col_ord FROM f""")
def append_roster(s, d):
    """Roster after appending: old columns first, new samples after them, samples already there skipped."""
    a, b = _batches(s, d)
    return metadata.append_roster(a, b)


@query(f"""WITH {OBS} SELECT 'modifiedC' AS assay, haplotype, strand, sample_id, row_id, least(sum(value), 10000)::INT AS value FROM obs WHERE assay IN ('5mC', '5hmC') GROUP BY ALL""")
def modified_sum_cap(s, d):
    return matrix.merge_modified(A.observations(s, d))


@query(f"""WITH {OBS}, a AS (SELECT sample_id FROM obs WHERE {C5} GROUP BY 1), b AS (SELECT sample_id FROM obs WHERE assay = '5hmC' AND haplotype = 'combined' AND strand = 'plus' GROUP BY 1)
SELECT sample_id FROM a INTERSECT SELECT sample_id FROM b""")
def roster_intersection(s, d):
    r = matrix.roster(A.observations(s, d))
    two = r.where(((F.col("assay") == "5mC") & (F.col("haplotype") == "combined") & (F.col("strand") == "combined")) | ((F.col("assay") == "5hmC") & (F.col("haplotype") == "combined") & (F.col("strand") == "plus")))
    return matrix.common_samples(two, 2)


@query(f"""WITH {META}, l AS (SELECT sample_id, sample_id AS alias FROM meta UNION ALL SELECT sample_id, donor FROM meta)
SELECT alias, min(sample_id) AS sample_id FROM l WHERE alias <> '' GROUP BY 1 HAVING count(DISTINCT sample_id) = 1""")
def alias_resolution(s, d):
    return matrix.resolve_aliases(A.metadata(s, d), ["sample_id", "donor"])


@query(f"""WITH {META}, r AS (SELECT DISTINCT sample_id FROM sample_track WHERE sample_id IS NOT NULL), k AS (SELECT lower(sample_id) AS key, * FROM meta)
SELECT r.sample_id, k.tissue, k.sex FROM r LEFT JOIN k ON lower(r.sample_id) = k.key""")
def metadata_alignment(s, d):
    r = A.read(s, d, "sample_track").where("sample_id IS NOT NULL").select("sample_id").distinct()
    m = A.metadata(s, d).withColumn("other", F.col("donor"))
    return metadata.align(r, m, ["other", "sample_id"]).select("sample_id", "tissue", "sex")


# ------------------------------------------------------------------ statistics


def _counts(s, d):
    obs = A.observations(s, d)
    every = A.read(s, d, "sample_track").select(*VIEW, "sample_id").distinct()  # also samples without a usable cell
    return matrix.observed_counts(obs, every)


CNT = f"""{OBS}, ros AS (SELECT DISTINCT assay, haplotype, strand, sample_id FROM sample_track),
cnt AS (SELECT r.assay, r.haplotype, r.strand, r.sample_id, count(o.row_id) AS n_observed FROM ros r LEFT JOIN obs o USING (assay, haplotype, strand, sample_id) GROUP BY ALL)"""


@query(f"WITH {CNT} SELECT * FROM cnt")
def observed_counts(s, d):
    return _counts(s, d)


@query(f"""WITH {CNT} SELECT assay, haplotype, strand, count(*) AS n_samples, count_if(n_observed > 0) AS n_with_data, avg(n_observed) AS mean_observed,
quantile_cont(n_observed, 0.5)::DOUBLE AS median_observed, min(n_observed) AS min_observed, max(n_observed) AS max_observed, avg(n_observed / 24000.0::DOUBLE) AS mean_fraction,
quantile_cont(n_observed / 24000.0::DOUBLE, 0.5) AS median_fraction FROM cnt GROUP BY ALL""")
def track_summary(s, d):
    n = A.index(s, d).count()
    return matrix.track_summary(_counts(s, d), n)


@query(f"WITH {CNT} SELECT *, row_number() OVER (PARTITION BY assay, haplotype, strand ORDER BY n_observed DESC, sample_id) AS rank FROM cnt")
def sample_rank(s, d):
    return matrix.sample_rank(_counts(s, d))


@query(f"""WITH {CNT}, {META}, l AS (SELECT sample_id, 'tissue' AS field, coalesce(trim(tissue), 'NA') AS value FROM meta UNION ALL SELECT sample_id, 'sex', coalesce(trim(sex), 'NA') FROM meta),
m AS (SELECT * FROM l WHERE value <> '' AND field IN (SELECT field FROM l WHERE value <> '' GROUP BY 1 HAVING count(DISTINCT value) >= 2))
SELECT assay, haplotype, strand, field, value, count(*) AS n_samples, sum(n_observed)::BIGINT AS n_observed FROM cnt JOIN m USING (sample_id) GROUP BY ALL""")
def metadata_group_summary(s, d):
    return matrix.metadata_group_summary(_counts(s, d), A.metadata(s, d), ["tissue", "sex"])


# ------------------------------------------------------------------ groups, regions, bins


def _grp(brk: str, method: str, least: int, src: str) -> str:
    return f"""x AS (SELECT *, sum(CASE WHEN {brk} THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY pos0, row_id ROWS UNBOUNDED PRECEDING) AS run FROM {src}),
g AS (SELECT chrom, chrom_ord, run, min(pos0)::BIGINT AS "start", max(pos0)::BIGINT + 2 AS "end", min(row_id) AS source_row_start, max(row_id) + 1 AS source_row_end, count(*) AS n_rows
  FROM x GROUP BY ALL HAVING count(*) >= {least}),
grp AS (SELECT row_number() OVER (ORDER BY chrom_ord, source_row_start) - 1 AS group_row, '{method}_' || row_number() OVER (ORDER BY chrom_ord, source_row_start) AS group_id,
  chrom, "start", "end", source_row_start, source_row_end, n_rows FROM g)"""


LAG = "l AS (SELECT *, pos0 - lag(pos0) OVER (PARTITION BY chrom ORDER BY pos0, row_id) AS dist FROM cpg_index)"
DEC = LAG + ", " + _grp("dist <= 200", "decode", 2, "l")


@query(f"WITH {DEC} SELECT * FROM grp")
def decode_groups(s, d):
    return grouping.distance_groups(A.index(s, d), gap=200, min_rows=2)


@query(f"WITH {DEC} SELECT count(*) AS n_groups, sum(n_rows)::BIGINT AS covered_rows, 24000.0::DOUBLE / count(*) AS reduction FROM grp")
def group_reduction(s, d):
    idx = A.index(s, d)
    return grouping.reduction_summary(grouping.distance_groups(idx, gap=200, min_rows=2), idx.count())


COR = f"""v AS (SELECT row_id, sample_id, value::BIGINT AS x FROM obs WHERE {C5}),
nx AS (SELECT row_id, lead(row_id) OVER (PARTITION BY chrom ORDER BY pos0, row_id) AS next_row FROM cpg_index),
pr AS (SELECT a.row_id, n.next_row, a.x, b.x AS y FROM v a JOIN nx n ON a.row_id = n.row_id JOIN v b ON b.row_id = n.next_row AND b.sample_id = a.sample_id),
sm AS (SELECT row_id, next_row, count(*) AS n, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, sum(x*x)::BIGINT AS sxx, sum(y*y)::BIGINT AS syy, sum(x*y)::BIGINT AS sxy FROM pr GROUP BY ALL),
cor AS (SELECT row_id, next_row, n AS n_shared, CASE WHEN n >= 3 AND n*sxx - sx*sx > 0 AND n*syy - sy*sy > 0
  THEN round((n*sxy - sx*sy)::DOUBLE / (sqrt((n*sxx - sx*sx)::DOUBLE) * sqrt((n*syy - sy*sy)::DOUBLE)), 9) END AS correlation FROM sm)"""


@query(f"WITH {OBS}, {COR} SELECT * FROM cor")
def adjacent_correlation(s, d):
    return grouping.adjacent_correlation(A.index(s, d), _view(s, d))


@query(f"WITH {OBS}, {COR}, {LAG}, k AS (SELECT l.*, c.correlation FROM l LEFT JOIN cor c ON c.next_row = l.row_id), {_grp('dist <= 2000 AND correlation >= 0.2', 'denovo', 2, 'k')} SELECT * FROM grp")
def denovo_groups(s, d):
    return grouping.correlated_groups(A.index(s, d), _view(s, d), min_correlation=0.2, gap=2000, min_shared=3)


@query(f"""WITH {OBS}, {DEC} SELECT o.assay, o.haplotype, o.strand, g.group_row, o.sample_id, round_even(sum(o.value)::DOUBLE / count(*), 0)::INT AS value, count(*) AS n_observed
FROM obs o JOIN grp g ON o.row_id >= g.source_row_start AND o.row_id < g.source_row_end GROUP BY ALL HAVING count(*) >= 2""")
def group_mean(s, d):
    g = grouping.distance_groups(A.index(s, d), gap=200, min_rows=2)
    return grouping.group_mean(A.observations(s, d), grouping.group_members(g), min_observed=2)


WIN = """reg AS (SELECT row_number() OVER (ORDER BY chrom, w) AS region_id, chrom, w * 50000 + 7000 AS s, w * 50000 + 31000 AS e FROM (SELECT DISTINCT chrom, pos0 // 50000 AS w FROM cpg_index))"""


def _windows(s, d):
    w = A.index(s, d).select("chrom", F.expr("pos0 div 50000").alias("w")).distinct()
    rank = F.row_number().over(Window.orderBy("chrom", "w"))  # one row per window of the index
    return w.select(rank.cast("long").alias("region_id"), "chrom", (F.col("w") * 50000 + 7000).cast("long").alias("start"), (F.col("w") * 50000 + 31000).cast("long").alias("end"))


@query(f"""WITH {WIN} SELECT r.region_id, r.chrom, min(i.pos0)::BIGINT AS "start", max(i.pos0)::BIGINT + 2 AS "end", min(row_id) AS source_row_start, max(row_id) + 1 AS source_row_end,
r.s::BIGINT AS reference_start, r.e::BIGINT AS reference_end, count(*) AS n_rows FROM reg r JOIN cpg_index i ON i.chrom = r.chrom AND i.pos0 >= greatest(r.s - 1, 0) AND i.pos0 < r.e GROUP BY ALL HAVING count(*) >= 2""")
def predefined_groups(s, d):
    return grouping.predefined_groups(A.index(s, d), _windows(s, d), left_shift=1, min_rows=2)


@query(f"WITH {WIN} SELECT DISTINCT i.* FROM cpg_index i JOIN reg r ON i.chrom = r.chrom AND i.pos0 >= r.s AND i.pos0 < r.e")
def region_point_filter(s, d):
    return ranges.points_covered(A.index(s, d), _windows(s, d))


@query(f"""WITH {OBS}, {WIN} SELECT r.region_id, o.sample_id, round(sum(o.value)::DOUBLE / count(*) / 10000.0, 9) AS fraction, count(*) AS n_observed
FROM obs o JOIN cpg_index i USING (row_id) JOIN reg r ON i.chrom = r.chrom AND i.pos0 >= r.s AND i.pos0 < r.e WHERE {C5} GROUP BY ALL""")
def region_mean(s, d):
    hit = ranges.points_in_intervals(A.index(s, d).select("row_id", "chrom", "pos0"), _windows(s, d))
    return matrix.region_mean(_view(s, d), hit.select(F.col("p_row_id").alias("row_id"), F.col("i_region_id").alias("region_id"))).withColumn("fraction", F.round("fraction", 9))


BIN = f"""{OBS}, bins AS (SELECT assay, haplotype, strand, sample_id, chrom, (pos0 // 100000)::BIGINT AS bin, round_even(sum(value)::DOUBLE / count(*), 0)::INT AS value, count(*) AS n_observed
FROM obs JOIN cpg_index USING (row_id) GROUP BY ALL)"""


@query(f"WITH {BIN} SELECT * FROM bins")
def bin_mean(s, d):
    return matrix.bin_mean(A.observations(s, d), A.index(s, d), 100000)


@query(f"""WITH {BIN}, {META}, lab AS (SELECT DISTINCT sample_id, trim(tissue) AS label FROM meta WHERE trim(tissue) <> ''), ros AS (SELECT DISTINCT assay, haplotype, strand, sample_id FROM obs),
sz AS (SELECT assay, haplotype, strand, label, count(*) AS n_samples FROM ros JOIN lab USING (sample_id) GROUP BY ALL)
SELECT b.assay, b.haplotype, b.strand, label, chrom, bin, round(sum(value)::DOUBLE / count(*) / 10000.0, 9) AS fraction, any_value(n_samples) AS n_samples
FROM bins b JOIN lab USING (sample_id) JOIN sz USING (assay, haplotype, strand, label) GROUP BY ALL""")
def group_bin_mean(s, d):
    obs = A.observations(s, d)
    g = matrix.group_bin_mean(matrix.bin_mean(obs, A.index(s, d), 100000), matrix.roster(obs), A.metadata(s, d), "tissue")
    return g.withColumn("fraction", F.round("fraction", 9))


# ------------------------------------------------------------------ segments


def _uni(gap: int) -> str:
    return f"""{SEG}, mx AS (SELECT chrom, s, e, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT chrom, s, e FROM seg WHERE name = 'different')),
fl AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM mx),
uni AS (SELECT row_number() OVER (ORDER BY chrom, min(s)) AS region_id, chrom, min(s) AS "start", max(e) AS "end" FROM fl GROUP BY chrom, grp)"""


def _union(s, d, gap, seg=None):
    seg = A.segments(s, d) if seg is None else seg
    return segments.merge_intervals(seg.where("name = 'different'"), gap)


def _segments_and_union(s, d):
    """The clean segments, made once, and their union."""
    seg = cut_lineage(A.segments(s, d))
    return seg, _union(s, d, 2000, seg)


@query(f"WITH {_uni(0)} SELECT * FROM uni")
def interval_merge(s, d):
    return _union(s, d, 0)


@query(f"WITH {_uni(2000)} SELECT * FROM uni")
def interval_merge_gap(s, d):
    return _union(s, d, 2000)


OVL = """ov AS (SELECT u.region_id, g.sample_id, g.effect_size AS v, least(g.e, u."end") - greatest(g.s, u."start") AS w FROM seg g JOIN uni u ON g.chrom = u.chrom AND g.s < u."end" AND g.e > u."start")"""


@query(f"WITH {_uni(2000)}, {OVL} SELECT region_id, sample_id, round(sum(v * w) / sum(w), 9) AS value FROM ov WHERE v IS NOT NULL AND isfinite(v) GROUP BY ALL")
def overlap_weighted_mean(s, d):
    return segments.project_metric(*_segments_and_union(s, d), "effect_size").withColumn("value", F.round("value", 9))


@query(f"""WITH {_uni(2000)}, {OVL}, sa AS (SELECT DISTINCT sample_id FROM seg), h AS (SELECT DISTINCT region_id, sample_id FROM ov)
SELECT u.region_id, sa.sample_id, CASE WHEN h.region_id IS NULL THEN 0 ELSE 1 END::INT AS value FROM uni u CROSS JOIN sa LEFT JOIN h ON h.region_id = u.region_id AND h.sample_id = sa.sample_id""")
def overlap_presence(s, d):
    seg, uni = _segments_and_union(s, d)
    return segments.project_presence(seg, uni, seg.select("sample_id").distinct())


@query(f"""WITH {_uni(2000)}, {OVL}, h AS (SELECT DISTINCT region_id, sample_id FROM ov)
SELECT region_id, count(*) AS n_support FROM h GROUP BY 1 HAVING count(*) >= 2 AND count(*) / (SELECT count(DISTINCT sample_id) FROM seg)::DOUBLE >= 0.02""")
def region_support(s, d):
    seg, uni = _segments_and_union(s, d)
    x = ranges.overlap_join(seg.select("sample_id", "chrom", "start", "end"), uni)
    hits = x.select(F.col("r_region_id").alias("region_id"), F.col("l_sample_id").alias("sample_id")).distinct()
    return segments.supported_regions(hits, seg.select("sample_id").distinct().count(), 2, 0.02)


# ------------------------------------------------------------------ strands

PAIR = f"""{OBS}, pm AS (SELECT row_id, sample_id, max(CASE WHEN strand = 'plus' THEN value END) AS p, max(CASE WHEN strand = 'minus' THEN value END) AS m FROM obs
  WHERE assay = '5mC' AND haplotype = 'combined' AND strand IN ('plus', 'minus') GROUP BY ALL HAVING count(DISTINCT strand) = 2)"""


def _score_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS n_paired, round(sum(p)::DOUBLE / count(*) / 10000, 9) AS mean_plus, round(sum(m)::DOUBLE / count(*) / 10000, 9) AS mean_minus,
  round((sum(p) - sum(m))::DOUBLE / count(*) / 10000, 9) AS mean_diff, round(abs((sum(p) - sum(m))::DOUBLE / count(*) / 10000), 9) AS abs_mean_diff,
  round((sum(p) + sum(m))::DOUBLE / (2 * count(*)) / 10000, 9) AS mean_total, round(abs((sum(p) - sum(m))::DOUBLE / count(*) / 10000) * sqrt(count(*)::DOUBLE), 9) AS score,
  CASE WHEN sum(p) >= sum(m) THEN 'plus>minus' ELSE 'minus>plus' END AS direction FROM {src} GROUP BY {keys}"""


SCO = f"{PAIR}, sco AS (SELECT * FROM ({_score_sql('pm', 'row_id')}) WHERE n_paired >= 2 AND mean_total >= 0.005)"
DOUBLES = ("mean_plus", "mean_minus", "mean_diff", "abs_mean_diff", "mean_total", "score")


def _r9(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 0.0, 9) for c in cols})


def _pairs(s, d):
    return strand.paired(A.observations(s, d).where("assay = '5mC' AND haplotype = 'combined'"))


def _scores(s, d):
    return _r9(strand.strand_scores(_pairs(s, d), 2, 0.005), *DOUBLES)


@query(f"WITH {SCO} SELECT * FROM sco")
def strand_scores(s, d):
    return _scores(s, d)


@query(f"""WITH {PAIR} SELECT sample_id, count(*) AS n_paired, round(sum(p)::DOUBLE / count(*) / 10000, 9) AS mean_plus, round(sum(m)::DOUBLE / count(*) / 10000, 9) AS mean_minus,
round((sum(p) - sum(m))::DOUBLE / count(*) / 10000, 9) AS mean_diff, round((sum(p) - sum(m))::DOUBLE / nullif(sum(p) + sum(m), 0), 9) AS balance FROM pm GROUP BY 1""")
def sample_strand_metrics(s, d):
    return _r9(strand.sample_metrics(_pairs(s, d)), "mean_plus", "mean_minus", "mean_diff", "balance")


CAT = f"{META}, cat AS (SELECT sample_id, tissue AS category FROM meta WHERE tissue <> '')"


def _category(s, d):
    return A.metadata(s, d).where("tissue <> ''").select("sample_id", F.col("tissue").alias("category"))


@query(f"""WITH {PAIR}, {CAT}, z AS (SELECT pm.*, category FROM pm JOIN cat USING (sample_id)), need AS (SELECT category, greatest(1, ceil(count(*) * 0.02)) AS need FROM cat GROUP BY 1)
SELECT q.* FROM ({_score_sql('z', 'category, row_id')}) q JOIN need USING (category) WHERE n_paired >= need AND mean_total >= 0.005""")
def category_scores(s, d):
    return _r9(strand.category_scores(_pairs(s, d), _category(s, d), 0.02, 0.005), *DOUBLES)


@query(f"""WITH {PAIR}, {CAT}, k AS (SELECT sample_id, (sum(p) - sum(m))::DOUBLE / count(*) / 10000 AS mean_diff, (sum(p) - sum(m))::DOUBLE / nullif(sum(p) + sum(m), 0) AS balance FROM pm GROUP BY 1)
SELECT category, count(DISTINCT sample_id) AS n_samples, round(quantile_cont(mean_diff, 0.5), 9) AS median_diff, round(avg(mean_diff), 9) AS mean_diff, round(quantile_cont(balance, 0.5), 9) AS median_balance
FROM k JOIN cat USING (sample_id) GROUP BY 1""")
def category_summary(s, d):
    return _r9(strand.category_summary(strand.sample_metrics(_pairs(s, d)), _category(s, d)), "median_diff", "mean_diff", "median_balance")


@query(f"WITH {SCO} SELECT * FROM sco ORDER BY score DESC, abs_mean_diff DESC, row_id LIMIT 100")
def hotspot_candidates(s, d):
    return strand.best_rows(_scores(s, d), strand.candidate_limit(5, 1))


CLU = f"""{SCO}, best AS (SELECT * FROM sco ORDER BY score DESC, abs_mean_diff DESC, row_id LIMIT 1000), placed AS (SELECT b.*, i.chrom, i.pos0 FROM best b JOIN cpg_index i USING (row_id)),
ru AS (SELECT *, sum(br) OVER (PARTITION BY chrom ORDER BY pos0, row_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN pos0 - lag(pos0) OVER w <= 1000 AND direction = lag(direction) OVER w THEN 0 ELSE 1 END AS br
  FROM placed WINDOW w AS (PARTITION BY chrom ORDER BY pos0, row_id))),
clu AS (SELECT chrom, run, direction, min(pos0)::BIGINT AS cluster_start, max(pos0)::BIGINT + 1 AS cluster_end, count(*) AS n_cpgs, max(score) AS max_score, max(abs_mean_diff) AS max_abs_mean_diff,
  arg_min(row_id, (-score, pos0, row_id)) AS representative_row_id FROM ru GROUP BY ALL)"""


def _clusters(s, d):
    return strand.hotspot_clusters(strand.best_rows(_scores(s, d), 1000), A.index(s, d), 1000)


@query(f"WITH {CLU} SELECT chrom, direction, cluster_start, cluster_end, n_cpgs, max_score, max_abs_mean_diff, representative_row_id, row_number() OVER (ORDER BY max_score DESC, max_abs_mean_diff DESC, n_cpgs DESC, chrom, cluster_start) AS rank FROM clu ORDER BY rank LIMIT 50")
def hotspot_clusters(s, d):
    return strand.ranked_clusters(_clusters(s, d), 50).drop("run")


@query(f"""WITH {CLU}, {CAT}, top AS (SELECT representative_row_id AS row_id FROM clu ORDER BY max_score DESC, max_abs_mean_diff DESC, n_cpgs DESC, chrom, cluster_start LIMIT 50)
SELECT row_id, category, count(*) AS n_samples, round(sum(p)::DOUBLE / count(*) / 10000, 9) AS mean_plus, round(sum(m)::DOUBLE / count(*) / 10000, 9) AS mean_minus,
round(quantile_cont((p - m) / 10000.0::DOUBLE, 0.5), 9) AS median_diff FROM pm JOIN top USING (row_id) JOIN cat USING (sample_id) GROUP BY ALL""")
def hotspot_profiles(s, d):
    top = strand.ranked_clusters(_clusters(s, d), 50)
    return _r9(strand.hotspot_profiles(_pairs(s, d), top, _category(s, d)), "mean_plus", "mean_minus", "median_diff")


CCLU = f"""{PAIR}, {CAT}, z AS (SELECT pm.*, category FROM pm JOIN cat USING (sample_id)), need AS (SELECT category, greatest(1, ceil(count(*) * 0.02)) AS need FROM cat GROUP BY 1),
csco AS (SELECT q.* FROM ({_score_sql('z', 'category, row_id')}) q JOIN need USING (category) WHERE n_paired >= need AND mean_total >= 0.005),
best AS (SELECT * FROM csco QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, abs_mean_diff DESC, row_id) <= 1000), placed AS (SELECT b.*, i.chrom, i.pos0 FROM best b JOIN cpg_index i USING (row_id)),
ru AS (SELECT *, sum(br) OVER (PARTITION BY category, chrom ORDER BY pos0, row_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN pos0 - lag(pos0) OVER w <= 1000 AND direction = lag(direction) OVER w THEN 0 ELSE 1 END AS br
  FROM placed WINDOW w AS (PARTITION BY category, chrom ORDER BY pos0, row_id))),
clu AS (SELECT category, chrom, run, direction, min(pos0)::BIGINT AS cluster_start, max(pos0)::BIGINT + 1 AS cluster_end, count(*) AS n_cpgs, max(score) AS max_score, max(abs_mean_diff) AS max_abs_mean_diff,
  arg_min(row_id, (-score, pos0, row_id)) AS representative_row_id FROM ru GROUP BY ALL)"""


@query(f"""WITH {CCLU} SELECT category, chrom, direction, cluster_start, cluster_end, n_cpgs, max_score, max_abs_mean_diff, representative_row_id,
row_number() OVER (PARTITION BY category ORDER BY max_score DESC, max_abs_mean_diff DESC, n_cpgs DESC, chrom, cluster_start) AS rank FROM clu QUALIFY rank <= 50""")
def category_clusters(s, d):
    best = strand.best_category_rows(category_scores(s, d), strand.candidate_limit(50, 1))
    return strand.ranked_clusters(strand.hotspot_clusters(best, A.index(s, d), 1000, by=("category",)), 50, ("category",)).drop("run")


SP = "assay = '5mC' AND haplotype = 'combined'"


@query(f"""WITH {CLU}, top AS (SELECT representative_row_id AS row_id, row_number() OVER (ORDER BY max_score DESC, max_abs_mean_diff DESC, n_cpgs DESC, chrom, cluster_start) AS rank FROM clu QUALIFY rank <= 50),
ros AS (SELECT sample_id FROM sample_track WHERE {SP} AND strand = 'plus' AND sample_id IS NOT NULL INTERSECT SELECT sample_id FROM sample_track WHERE {SP} AND strand = 'minus'),
c AS (SELECT row_id, sample_id, max(CASE WHEN strand = 'plus' THEN value END) AS p, max(CASE WHEN strand = 'minus' THEN value END) AS m FROM obs WHERE {SP} AND strand IN ('plus', 'minus') GROUP BY ALL)
SELECT row_id, rank, sample_id, p / 10000.0::DOUBLE AS plus_value, m / 10000.0::DOUBLE AS minus_value, (p - m) / 10000.0::DOUBLE AS diff_value, (p IS NOT NULL AND m IS NOT NULL) AS is_paired
FROM top CROSS JOIN ros LEFT JOIN c USING (row_id, sample_id)""")
def hotspot_sample_profiles(s, d):
    t = A.read(s, d, "sample_track").where(SP).where("sample_id IS NOT NULL")
    both = t.where("strand = 'plus'").select("sample_id").intersect(t.where("strand = 'minus'").select("sample_id"))
    return strand.sample_profiles(A.observations(s, d).where(SP), strand.ranked_clusters(_clusters(s, d), 50), both)


# ------------------------------------------------------------------ export

#: Samples of the busiest kind share rows; the export works on those that share the control's rows most.
TOP = f"""vw AS (SELECT row_id, sample_id, value FROM obs WHERE {C5}), sel AS (SELECT sample_id FROM vw GROUP BY 1 ORDER BY count(*) DESC, sample_id LIMIT 12)"""


def _selected(view: DataFrame) -> DataFrame:
    """The twelve samples with most cells: the selection that a user would pass as a sample list."""
    return view.groupBy("sample_id").agg(F.count(F.lit(1)).alias("k")).orderBy(F.col("k").desc(), "sample_id").limit(12).select("sample_id")


LAB = f"""{OBS}, {TOP}, st AS (SELECT row_id, count(*) AS n, min(value) AS lo, max(value) AS hi, sum(value) AS s FROM vw JOIN sel USING (sample_id) GROUP BY 1),
labd AS (SELECT i.row_id, coalesce(n, 0) AS n_observed, s::DOUBLE / n AS row_mean, CASE WHEN n IS NULL THEN 'all_missing' WHEN n / 12.0::DOUBLE < 0.15 THEN 'below_presence'
  WHEN lo = hi THEN 'constant' ELSE 'written' END AS label FROM cpg_index i LEFT JOIN st USING (row_id))"""


@query(f"WITH {LAB} SELECT row_id, n_observed, round(row_mean, 9) AS row_mean, label FROM labd")
def export_filter_labels(s, d):
    v = _view(s, d)
    return export.label_rows(A.index(s, d), v, _selected(v), 0.15, "mean").withColumn("row_mean", F.round("row_mean", 9))


@query(f"WITH {LAB} SELECT label, count(*) AS n_rows FROM labd GROUP BY 1")
def export_receipt(s, d):
    v = _view(s, d)
    return export.receipt(export.label_rows(A.index(s, d), v, _selected(v), 0.15, "mean"))


@query(f"""WITH {LAB} SELECT l.row_id, sel.sample_id, round(coalesce(vw.value::DOUBLE, row_mean) / 10000, 9) AS fraction, (vw.value IS NULL)::INT AS imputed
FROM labd l CROSS JOIN sel LEFT JOIN vw ON vw.row_id = l.row_id AND vw.sample_id = sel.sample_id WHERE label = 'written'""")
def export_mean_impute(s, d):
    v = _view(s, d)
    sel = _selected(v)
    cells = export.dense_rows(export.label_rows(A.index(s, d), v, sel, 0.15, "mean"), v, sel)
    return cells.withColumn("fraction", F.round("fraction", 9))


#: The same over every sample of the view, also those without a usable cell.
ROS = f"""{OBS}, vw AS (SELECT row_id, sample_id, value FROM obs WHERE {C5}), sel AS (SELECT DISTINCT sample_id FROM sample_track WHERE {C5} AND sample_id IS NOT NULL),
st AS (SELECT row_id, count(*) AS n, min(value) AS lo, max(value) AS hi, sum(value) AS s FROM vw GROUP BY 1),
labd AS (SELECT i.row_id, coalesce(n, 0) AS n_observed, s::DOUBLE / n AS row_mean, CASE WHEN n IS NULL THEN 'all_missing' WHEN n / (SELECT count(*) FROM sel)::DOUBLE < 0.15 THEN 'below_presence'
  WHEN lo = hi THEN 'constant' ELSE 'written' END AS label FROM cpg_index i LEFT JOIN st USING (row_id))"""


def _roster(s, d) -> DataFrame:
    """Every sample of the 5mC view, also those without a usable cell."""
    t = matrix.select_view(A.read(s, d, "sample_track"), *V5)
    return t.where("sample_id IS NOT NULL").select("sample_id").distinct()


@query(f"WITH {ROS} SELECT row_id, n_observed, round(row_mean, 9) AS row_mean, label FROM labd")
def export_roster_labels(s, d):
    return export.label_rows(A.index(s, d), _view(s, d), _roster(s, d), 0.15, "mean").withColumn("row_mean", F.round("row_mean", 9))


@query(f"WITH {ROS} SELECT label, count(*) AS n_rows FROM labd GROUP BY 1")
def export_roster_receipt(s, d):
    return export.receipt(export.label_rows(A.index(s, d), _view(s, d), _roster(s, d), 0.15, "mean"))


@query(f"""WITH {ROS} SELECT l.row_id, sel.sample_id, round(coalesce(vw.value::DOUBLE, row_mean) / 10000, 9) AS fraction, (vw.value IS NULL)::INT AS imputed
FROM labd l CROSS JOIN sel LEFT JOIN vw ON vw.row_id = l.row_id AND vw.sample_id = sel.sample_id WHERE label = 'written'""")
def export_roster_impute(s, d):
    v, ros = _view(s, d), _roster(s, d)
    cells = export.dense_rows(export.label_rows(A.index(s, d), v, ros, 0.15, "mean"), v, ros)
    return cells.withColumn("fraction", F.round("fraction", 9))


@query(f"WITH {DEC} SELECT * FROM grp WHERE chrom = 'chr2' AND \"start\" < 900000 AND \"end\" > 100000")
def export_region(s, d):
    g = grouping.distance_groups(A.index(s, d), gap=200, min_rows=2)
    r = codec.parse_half_open_region("chr2:100000-900000")
    return export.in_region(g, r.chrom, r.start, r.end, grouped=True)


@query(f"""WITH {OBS}, vw AS (SELECT row_id, sample_id, value FROM obs WHERE {C5})
SELECT row_id, max(CASE WHEN sample_id = '{CTRL}' THEN value / 10000.0::DOUBLE END) AS control, max(CASE WHEN sample_id = 'MB00000001' THEN value / 10000.0::DOUBLE END) AS first_sample FROM vw GROUP BY 1""")
def export_wide(s, d):
    cells = _view(s, d).withColumn("fraction", codec.decode_fraction(F.col("value")))
    return export.wide(cells, [(CTRL, "control"), ("MB00000001", "first_sample")])


# ------------------------------------------------------------------ profiles, PCA, alignment


@query(f"""WITH {OBS}, vw AS (SELECT row_id, sample_id FROM obs WHERE {C5}), k AS (SELECT count(DISTINCT sample_id) AS k FROM vw)
SELECT row_id, count(*) AS n_observed FROM vw GROUP BY 1 HAVING count(*) / (SELECT k FROM k)::DOUBLE >= 0.02""")
def presence_filter(s, d):
    v = _view(s, d)
    return matrix.presence_rows(v, _samples(v).count(), 0.02)


@query(f"""WITH {OBS}, m AS (SELECT sample_id, count(*) AS n, avg(value / 10000.0::DOUBLE) AS mean, stddev_samp(value / 10000.0::DOUBLE) AS std FROM obs WHERE {C5} GROUP BY 1)
SELECT sample_id, n, CASE WHEN n > 1 THEN round(mean, 8) ELSE 0 END AS mean, CASE WHEN n > 1 AND std > 1e-12 THEN round(std, 8) ELSE 1 END AS std FROM m""")
def moments_per_sample(s, d):
    v = _view(s, d)
    return matrix.moments(v, v.select("row_id").distinct()).withColumns({"mean": F.round("mean", 8), "std": F.round("std", 8)})


@query(f"WITH {OBS} SELECT row_id, sample_id, round(sum(value) / 10000.0::DOUBLE, 9) AS fraction FROM obs WHERE haplotype = 'combined' AND strand = 'combined' GROUP BY ALL")
def track_combine_sum(s, d):
    return matrix.combine_tracks(matrix.select_tracks(A.observations(s, d), "all", "combined", "combined"), "sum").withColumn("fraction", F.round("fraction", 9))


@query(f"WITH {OBS} SELECT row_id, sample_id, round(avg(value) / 10000.0::DOUBLE, 9) AS fraction FROM obs WHERE haplotype = 'combined' AND strand = 'combined' GROUP BY ALL")
def track_combine_mean(s, d):
    return matrix.combine_tracks(matrix.select_tracks(A.observations(s, d), "all", "combined", "combined"), "mean").withColumn("fraction", F.round("fraction", 9))


@query(f"""WITH {OBS}, q AS (SELECT o.*, i.pos0, count(*) OVER (PARTITION BY assay, haplotype, strand, sample_id) AS m, row_number() OVER w AS i, avg(pos0) OVER x AS px, sum(value) OVER x / count(*) OVER x / 10000.0::DOUBLE AS pv
FROM obs o JOIN cpg_index i USING (row_id) WHERE i.chrom = 'chr2' WINDOW w AS (PARTITION BY assay, haplotype, strand, sample_id ORDER BY pos0, row_id), x AS (PARTITION BY assay, haplotype, strand, sample_id ORDER BY pos0, row_id ROWS 4 PRECEDING))
SELECT assay, haplotype, strand, sample_id, round(CASE WHEN m < 5 THEN pos0 ELSE px END, 6) AS pos0_mean, round(CASE WHEN m < 5 THEN value / 10000.0::DOUBLE ELSE pv END, 9) AS fraction FROM q WHERE m < 5 OR i >= 5""")
def sliding_mean(s, d):
    """Smoothed profiles of one locus, a whole chromosome."""
    at = A.observations(s, d).join(A.index(s, d).where("chrom = 'chr2'").select("row_id", "pos0"), "row_id")
    return matrix.sliding_mean(at, 5).withColumns({"pos0_mean": F.round("pos0_mean", 6), "fraction": F.round("fraction", 9)})


@query(f"""WITH {OBS}, q AS (SELECT o.*, i.chrom, i.pos0, count(*) OVER (PARTITION BY assay, haplotype, strand, sample_id, chrom) AS m, row_number() OVER w AS i, avg(pos0) OVER x AS px, sum(value) OVER x / count(*) OVER x / 10000.0::DOUBLE AS pv
FROM obs o JOIN cpg_index i USING (row_id) WINDOW w AS (PARTITION BY assay, haplotype, strand, sample_id, chrom ORDER BY pos0, row_id), x AS (PARTITION BY assay, haplotype, strand, sample_id, chrom ORDER BY pos0, row_id ROWS 4 PRECEDING))
SELECT assay, haplotype, strand, sample_id, chrom, round(CASE WHEN m < 5 THEN pos0 ELSE px END, 6) AS pos0_mean, round(CASE WHEN m < 5 THEN value / 10000.0::DOUBLE ELSE pv END, 9) AS fraction FROM q WHERE m < 5 OR i >= 5""")
def sliding_mean_chromosomes(s, d):
    """Smoothed profiles of every chromosome."""
    at = A.observations(s, d).join(A.index(s, d).select("row_id", "chrom", "pos0"), "row_id")
    return matrix.sliding_mean(at, 5, by=("chrom",)).withColumns({"pos0_mean": F.round("pos0_mean", 6), "fraction": F.round("fraction", 9)})


@query(f"""WITH {DEC}, t AS (SELECT row_id AS target_row, chrom, pos0::BIGINT AS s, pos0::BIGINT + 2 AS e FROM cpg_index UNION ALL SELECT 1000000 + group_row, chrom, "start", "end" FROM grp WHERE group_row % 3 < 2)
SELECT g.group_row, t.target_row, (t.target_row IS NOT NULL) AS matched FROM grp g LEFT JOIN t ON t.chrom = g.chrom AND t.s = g."start" AND t.e = g."end" """)
def atlas_alignment(s, d):
    """Exact interval alignment of grouped rows with a row system of sites and two thirds of the groups;
    unmatched ones are reported."""
    g = grouping.distance_groups(A.index(s, d), gap=200, min_rows=2)
    sites = A.index(s, d).select(F.col("row_id").alias("target_row"), "chrom", F.col("pos0").cast("long").alias("start"), (F.col("pos0").cast("long") + 2).alias("end"))
    some = g.where("group_row % 3 < 2").select((F.col("group_row") + 1000000).alias("target_row"), "chrom", "start", "end")
    return metadata.align_rows(g, sites.unionByName(some))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS f FROM embeddings),
z AS (SELECT f, vec_id, x::DOUBLE AS x FROM e), c AS (SELECT f, avg(x) AS m FROM z GROUP BY 1)
SELECT a.f::INT AS i, b.f::INT AS j, round(sum((a.x - ca.m) * (b.x - cb.m)), 5) AS g FROM z a JOIN z b USING (vec_id) JOIN c ca ON ca.f = a.f JOIN c cb ON cb.f = b.f GROUP BY ALL""")
def gram_matrix(s, d):
    """Gram matrix of the 64 embedding features, each centred over all vectors."""
    e = A.read(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("f", "x"))
    z = e.select(F.col("vec_id").alias("row_id"), (F.col("f") + 1).cast("string").alias("sample_id"), F.col("x").cast("double").alias("x"))
    m = z.groupBy("sample_id").agg(F.avg("x").alias("m"))
    names = [str(i + 1) for i in range(64)]
    g = embed.gram_matrix(z.join(F.broadcast(m), "sample_id").select("row_id", "sample_id", (F.col("x") - F.col("m")).alias("z")), names)
    rows = [(i + 1, j + 1, float(np.round(g[i, j], 5)) + 0.0) for i in range(64) for j in range(64)]
    return s.createDataFrame(rows, "i int, j int, g double")


def _embedded(s, d, min_present):
    """PCA of the whole roster of the 5mC view; the names and coordinates of one view reach the driver."""
    names = _roster(s, d).orderBy("sample_id").toPandas()["sample_id"].tolist()
    v = keep(_view(s, d))
    rows = matrix.presence_rows(v, len(names), min_present)
    return names, *embed.pca(embed.standardised(v, rows, matrix.moments(v, rows)), names, 5)


def _numbers(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), mask=~np.isfinite(x))


def _coordinate_rows(s, names, x, ratio):
    k, n = x.shape
    rows = {"sample_id": pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(k), n))), "component": pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), k)), "coordinate": _numbers(x.ravel()), "explained": _numbers(np.tile(ratio, k))}
    return s.createDataFrame(pa.table(rows), "sample_id string, component int, coordinate double, explained double")


def _outlier_rows(s, names, x):
    dist, out = embed.mahalanobis(x[:, :3], 0.999)
    rows = {"sample_id": pa.array(names, pa.string()), "distance": _numbers(dist), "is_outlier": pa.array(out, pa.bool_())}
    return s.createDataFrame(pa.table(rows), "sample_id string, distance double, is_outlier boolean")


@query()
def pca_coordinates(s, d):
    """Whole roster, rows observed in 15 % of it; null coordinates where no row is."""
    return _coordinate_rows(s, *_embedded(s, d, 0.15))


@query()
def mahalanobis_outliers(s, d):
    names, x, _ = _embedded(s, d, 0.15)
    return _outlier_rows(s, names, x)


@query()
def pca_roster(s, d):
    """Whole roster over every observed row."""
    return _coordinate_rows(s, *_embedded(s, d, 0.0))


@query()
def mahalanobis_roster(s, d):
    names, x, _ = _embedded(s, d, 0.0)
    return _outlier_rows(s, names, x)
