"""Queries of stored definitions, sample metadata, stores and reports, each beside its SQL."""

from __future__ import annotations

from urllib.parse import urlparse
from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import codec
from ..functions.codec import TrackKey
from ..operators import export, grouping, matrix, metadata, ranges, reports, strand, validate
from ..session import ensure_checkpoint_dir
from ..sources import definitions, store
from . import adapters as A
from . import queries as Q
from .adapters import META, OBS
from .queries import BIN, C5, CAT, CTRL, LAG, PAIR, VIEW, WIN

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ definitions

UNITS = f"{LAG}, {Q._grp('dist <= 10', 'decode', 1, 'l')}"


def _units(s, d):
    g = grouping.distance_groups(A.index(s, d), 10, 1)
    return g.join(F.broadcast(A.index(s, d).select("chrom", "chrom_ord").distinct()), "chrom").select("chrom", "chrom_ord", "start", "end")  # one row per chromosome


@query(f"""WITH {UNITS} SELECT g.chrom, c.chrom_ord, row_number() OVER (PARTITION BY g.chrom ORDER BY "start") AS i, "start" - coalesce(lag("start") OVER (PARTITION BY g.chrom ORDER BY "start"), 0) AS start_delta,
"end" - "start" AS length FROM grp g JOIN (SELECT DISTINCT chrom, chrom_ord FROM cpg_index) c USING (chrom)""")
def definition_deltas(s, d):
    return definitions.encode_starts(_units(s, d))


@query(f"""WITH {UNITS} SELECT g.chrom, c.chrom_ord, "start", "end" FROM grp g JOIN (SELECT DISTINCT chrom, chrom_ord FROM cpg_index) c USING (chrom)""")
def definition_decoded(s, d):
    return definitions.decode_starts(definitions.encode_starts(_units(s, d)))


@query("SELECT chrom, row_id // 4096 AS block, sha256(string_agg(pos0::VARCHAR, ',' ORDER BY row_id)) AS digest FROM cpg_index GROUP BY ALL")
def position_digests(s, d):
    return definitions.position_digests(A.index(s, d))


@query("""WITH x AS (SELECT sample_id, chrom, chrom_start AS s, chrom_end AS e FROM asm_segment),
w AS (SELECT *, max(CASE WHEN e > s THEN e END) OVER (PARTITION BY sample_id, chrom ORDER BY s NULLS FIRST, e NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, lag(s) OVER q AS ps, lag(e) OVER q AS pe FROM x
  WINDOW q AS (PARTITION BY sample_id, chrom ORDER BY s NULLS FIRST, e NULLS FIRST))
SELECT count(*) AS n_rows, count_if(s IS NULL OR s < 0) AS n_negative, count_if(NOT coalesce(e > s, false)) AS n_empty, count_if(coalesce(s = ps AND e = pe, false)) AS n_repeated, count_if(coalesce(s < reach, false)) AS n_overlapping FROM w""")
def interval_violations(s, d):
    t = A.read(s, d, "asm_segment").withColumnsRenamed({"chrom_start": "start", "chrom_end": "end"})
    return validate.interval_violations(t, ("sample_id", "chrom"))


@query("""WITH c AS (SELECT assay, haplotype, strand, sample_id, row_id, count(*) AS n, count_if(NOT coalesce(value_u16 BETWEEN 0 AND 10000, false)) AS v, count_if(NOT coalesce(coverage BETWEEN 0 AND 65534, false)) AS c FROM sample_track GROUP BY ALL)
SELECT assay, haplotype, strand, sample_id, sum(n)::BIGINT AS n_cells, sum(v)::BIGINT AS n_bad_value, sum(c)::BIGINT AS n_bad_coverage, count_if(NOT coalesce(row_id BETWEEN 0 AND 11999, false)) AS n_off_index, count_if(n > 1) AS n_repeated FROM c GROUP BY ALL""")
def track_violations(s, d):
    """Structure of the raw tracks against the first half of the index."""
    return validate.track_violations(A.read(s, d, "sample_track").withColumnRenamed("value_u16", "value"), 12000)


# ------------------------------------------------------------------ strings and metadata


@query("""WITH n AS (SELECT DISTINCT tissue_name, lower(trim(tissue_name)) AS n FROM sample_meta)
SELECT tissue_name, CASE WHEN n = '' OR n IS NULL THEN NULL WHEN n LIKE 'brain%' THEN 'Brain / CNS' WHEN n LIKE 'skin%' OR n LIKE '%dermal fibroblast%' THEN 'Skin / Connective' WHEN n LIKE 'muscle%' THEN 'Musculoskeletal'
WHEN n LIKE 'heart%' OR n LIKE 'aorta%' THEN 'Cardiovascular' WHEN n LIKE 'blood%' THEN 'Blood / Immune' WHEN n LIKE 'lung%' THEN 'Respiratory' WHEN n LIKE 'colon%' OR n LIKE 'esophagus%' OR n LIKE 'liver%' THEN 'Digestive'
WHEN n LIKE 'adrenal%' THEN 'Endocrine' WHEN n LIKE 'ovary%' OR n LIKE 'testis%' THEN 'Reproductive' ELSE 'Other' END AS tissue_broad, replace(replace(replace(tissue_name, '/', '_'), ' ', '_'), ',', '') AS file_part FROM n""")
def broad_tissues(s, d):
    t = A.read(s, d, "sample_meta").select("tissue_name").distinct()
    return metadata.fill_broad_tissue(t).withColumn("file_part", codec.safe_file_part(F.col("tissue_name")))


_FORMS = ("sample_id", "'/data/run 1/' || sample_id || '.bam'", "'SMHT001-A-B1-C-D-E-' || sample_id", "' ' || sample_id || '.smdb '")


@query(f"""WITH f AS ({" UNION ALL ".join(f"SELECT DISTINCT {f} AS form FROM sample_meta" for f in _FORMS)}),
b AS (SELECT form, regexp_replace(regexp_extract(trim(form), '([^/]*)$', 1), '\\.(smdb|mmdb|mdb|bam|bai)$', '') AS base FROM f)
SELECT DISTINCT form, CASE WHEN form IS NULL OR trim(form) = '' OR lower(trim(form)) = 'nan' THEN '' WHEN regexp_extract(base, '^(SMHT[^-]+(-[^-]+){{5}})', 1) <> '' THEN regexp_extract(base, '^(SMHT[^-]+(-[^-]+){{5}})', 1) ELSE base END AS root FROM b""")
def sample_roots(s, d):
    m = A.read(s, d, "sample_meta")
    forms = m.select(F.explode(F.array(*[F.expr(f) for f in _FORMS])).alias("form"))
    return forms.distinct().select("form", codec.canonical_root(F.col("form")).alias("root"))


@query("""SELECT DISTINCT hotspot_id, cluster_start, cluster_end, chrom, 'H' || n_cpgs || ': ' || chrom || ':' || format('{:,}', cluster_start + 1) || '-' || format('{:,}', cluster_end) AS label FROM strand_hotspot""")
def hotspot_labels(s, d):
    h = A.read(s, d, "strand_hotspot")
    label = codec.thousands_label(F.col("n_cpgs"), F.col("chrom"), F.col("cluster_start"), F.col("cluster_end"))
    return h.select("hotspot_id", "cluster_start", "cluster_end", "chrom", label.alias("label")).distinct()


_COLS = ("donor", "tissue_name", "sex", "age_years", "platform", "batch_id", "collected_at")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name FROM sample_meta HAVING count(DISTINCT nullif(trim({c}::VARCHAR), '')) BETWEEN 2 AND 40" for c in _COLS))
def category_columns(s, d):
    return s.createDataFrame([(c,) for c in metadata.category_columns(A.read(s, d, "sample_meta"))], "name string")


@query(f"""WITH {META}, r AS (SELECT DISTINCT sample_id FROM sample_track WHERE sample_id IS NOT NULL) SELECT r.sample_id, tissue, sex FROM r LEFT JOIN meta ON trim(r.sample_id) = trim(meta.sample_id)""")
def metadata_by_root(s, d):
    """Metadata whose ids are paths of stores: only the roots fit."""
    m = A.metadata(s, d).select(F.concat(F.lit("/stores/"), F.trim("sample_id"), F.lit(".smdb")).alias("id"), F.col("donor").alias("sample"), "tissue", "sex")
    r = A.read(s, d, "sample_track").where("sample_id IS NOT NULL").select("sample_id")
    return metadata.align_roots(r, m, ["sample", "id"], "id").select("sample_id", "tissue", "sex")


SEL = "ids AS (SELECT DISTINCT sample_id FROM sample_track WHERE sample_id IS NOT NULL INTERSECT SELECT sample_id FROM meta), num AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS col_ord FROM ids)"


def _numbered(s, d):
    ids = A.read(s, d, "sample_track").select("sample_id").where("sample_id IS NOT NULL").intersect(A.metadata(s, d).select("sample_id"))
    return ids.select("sample_id", F.row_number().over(Window.orderBy("sample_id")).cast("long").alias("col_ord"))  # one row per sample


@query(f"WITH {META}, {SEL} SELECT sample_id AS id, col_ord, tissue FROM num JOIN meta USING (sample_id)")
def metadata_selected(s, d):
    return metadata.select_rows(A.metadata(s, d).withColumnRenamed("sample_id", "id"), _numbered(s, d)).select("id", "col_ord", "tissue")


@query(f"WITH {META}, {SEL}, m AS (SELECT donor, row_number() OVER (ORDER BY donor, sample_id) AS col_ord FROM meta JOIN ids USING (sample_id)) SELECT sample_id, col_ord, donor FROM num JOIN m USING (col_ord)")
def metadata_by_position(s, d):
    """Metadata without ids, row by row."""
    ids = _numbered(s, d)
    m = A.metadata(s, d).join(ids, "sample_id", "left_semi")
    m = m.select("donor", F.row_number().over(Window.orderBy(F.col("donor").asc_nulls_last(), "sample_id")).alias("line"))  # one row per sample
    return metadata.align_by_position(ids, m, "line").select("sample_id", "col_ord", "donor")


@query("""WITH c AS (SELECT DISTINCT assay, haplotype, strand, sample_id FROM sample_track WHERE sample_id IS NOT NULL),
v AS (SELECT sample_id, dense_rank() OVER (ORDER BY assay, haplotype, strand) AS view_ord, row_number() OVER (PARTITION BY assay, haplotype, strand ORDER BY sample_id DESC) AS col_ord FROM c),
f AS (SELECT sample_id, min((view_ord, col_ord)) AS seen FROM v GROUP BY 1) SELECT sample_id, row_number() OVER (ORDER BY seen, sample_id) AS col_ord FROM f""")
def roster_union(s, d):
    c = A.read(s, d, "sample_track").where("sample_id IS NOT NULL").select(*VIEW, "sample_id").distinct()
    views = c.select(*VIEW).distinct().select(*VIEW, F.row_number().over(Window.orderBy(*VIEW)).alias("view_ord"))  # one row per view
    at = F.row_number().over(Window.partitionBy(*VIEW).orderBy(F.col("sample_id").desc()))
    return metadata.union_rosters(c.withColumn("col_ord", at).join(F.broadcast(views), VIEW))


# ------------------------------------------------------------------ stores


def _folder(s) -> str:
    """A new folder for a store beside the checkpoints, where the driver mounts it."""
    ensure_checkpoint_dir(s)
    return f"{urlparse(s.sparkContext._jsc.sc().getCheckpointDir().get()).path}/store-{uuid4().hex}"


def _cohort(s, d) -> str:
    """The 5mC view of the test tables as a written cohort."""
    obs = A.observations(s, d).where(C5).join(A.index(s, d).select("row_id", "chrom"), "row_id")
    names = [r["sample_id"] for r in obs.where("sample_id IS NOT NULL").select("sample_id").distinct().orderBy("sample_id").collect()]  # the catalog of a cohort
    cols = [{"assay": "5mC", "haplotype": "combined", "strand": "combined", "sample_id": n, "platform": "", "bundle_path": ""} for n in names]
    path = _folder(s)
    store.write_cohort(obs, cols, path, "cpg_index")
    return path


KEY = TrackKey("5mC", "combined", "combined")
_CELLS = f"(SELECT * FROM obs WHERE {C5} AND sample_id = '{CTRL}') o"


@query(f"WITH {OBS} SELECT i.row_id, i.chrom, i.pos0, o.value / 10000.0::DOUBLE AS fraction FROM cpg_index i LEFT JOIN {_CELLS} USING (row_id) WHERE i.chrom = 'chr1' AND i.pos0 BETWEEN 10000 AND 1500000")
def store_range(s, d):
    r = codec.parse_inclusive_region("chr1:10000-1500000")
    return store.query_range(s, _cohort(s, d), A.index(s, d), KEY, CTRL, r.chrom, r.start, r.end)


@query(f"WITH {OBS} SELECT i.row_id, i.pos0, o.value / 100.0::DOUBLE AS percent FROM cpg_index i LEFT JOIN {_CELLS} USING (row_id) WHERE i.chrom = 'chr1' AND i.pos0 = 10097")
def store_point(s, d):
    r = codec.parse_locus("chr1:10097")
    x = store.query_point(s, _cohort(s, d), A.index(s, d), KEY, CTRL, r.chrom, r.start)
    return s.createDataFrame([(x["row_id"], x["pos0"], x["percent"])] if x else [], "row_id long, pos0 int, percent double")


@query(f"WITH {OBS} SELECT row_id, value / 10000.0::DOUBLE AS fraction FROM obs JOIN cpg_index i USING (row_id) WHERE {C5} AND sample_id = '{CTRL}' AND i.chrom = 'chr1' AND i.pos0 BETWEEN 10000 AND 1500000")
def bundle_range(s, d):
    """A range of a written sample bundle: observed rows only."""
    obs = A.observations(s, d).where(f"{C5} AND sample_id = '{CTRL}'").join(A.index(s, d).select("row_id", "chrom"), "row_id")
    path = _folder(s)
    store.write_bundle(obs.drop("sample_id"), path, CTRL, "ont", "cpg_index")
    return store.query_range(s, path, A.index(s, d), KEY, CTRL, "chr1", 10000, 1500001).select("row_id", "fraction")


# ------------------------------------------------------------------ regions, exports and reports


@query(f"""WITH {OBS}, {WIN}, n AS (SELECT r.region_id, count(*) AS n_cpgs FROM reg r JOIN cpg_index i ON i.chrom = r.chrom AND i.pos0 >= r.s AND i.pos0 < r.e GROUP BY 1),
m AS (SELECT r.region_id, o.sample_id, round(sum(o.value)::DOUBLE / count(*) / 10000.0, 9) AS fraction FROM obs o JOIN cpg_index i USING (row_id) JOIN reg r ON i.chrom = r.chrom AND i.pos0 >= r.s AND i.pos0 < r.e WHERE {C5} GROUP BY ALL)
SELECT region_id, r.chrom, r.s::BIGINT AS "start", r.e::BIGINT AS "end", coalesce(n_cpgs, 0) AS n_cpgs, sample_id, fraction FROM reg r LEFT JOIN n USING (region_id) LEFT JOIN m USING (region_id)""")
def region_table(s, d):
    w = Q._windows(s, d)
    hit = ranges.points_in_intervals(A.index(s, d).select("row_id", "chrom", "pos0"), w).select(F.col("p_row_id").alias("row_id"), F.col("i_region_id").alias("region_id"))
    return matrix.region_table(Q._view(s, d), hit, w).withColumn("fraction", F.round("fraction", 9))


@query(f"""WITH {OBS}, vw AS (SELECT row_id, sample_id, value FROM obs WHERE {C5}), sel AS (SELECT sample_id FROM vw GROUP BY 1 ORDER BY count(*) DESC, sample_id LIMIT 2),
st AS (SELECT row_id, count(*) AS n, min(value) AS lo, max(value) AS hi, sum(value) AS s FROM vw JOIN sel USING (sample_id) GROUP BY 1)
SELECT i.row_id, coalesce(n, 0) AS n_observed, s::DOUBLE / n AS row_mean, CASE WHEN n IS NULL THEN 'all_missing' WHEN n < 2 THEN 'remaining_missing' WHEN lo = hi THEN 'constant' ELSE 'written' END AS label FROM cpg_index i LEFT JOIN st USING (row_id)""")
def export_drop_labels(s, d):
    """The labels of an export of two samples that drops rows with a missing cell."""
    v = Q._view(s, d)
    two = v.groupBy("sample_id").agg(F.count(F.lit(1)).alias("k")).orderBy(F.col("k").desc(), "sample_id").limit(2).select("sample_id")
    return export.label_rows(A.index(s, d), v, two, 0.5, "drop")


@query(f"""WITH {OBS}, {CAT}, x AS (SELECT o.assay, o.haplotype, o.strand, i.chrom, i.pos0, row_id, coalesce(nullif(trim(category), ''), 'NA') AS category, value FROM obs o JOIN cpg_index i USING (row_id) LEFT JOIN cat USING (sample_id)),
g AS (SELECT assay, haplotype, strand, category, chrom, row_id, pos0, sum(value)::DOUBLE / count(*) AS value FROM x GROUP BY ALL),
q AS (SELECT *, count(*) OVER (PARTITION BY assay, haplotype, strand, category, chrom) AS m, row_number() OVER w AS i, avg(pos0) OVER r AS px, avg(value) OVER r / 10000.0::DOUBLE AS pv FROM g
  WINDOW w AS (PARTITION BY assay, haplotype, strand, category, chrom ORDER BY pos0, row_id), r AS (PARTITION BY assay, haplotype, strand, category, chrom ORDER BY pos0, row_id ROWS 9 PRECEDING))
SELECT assay, haplotype, strand, category, chrom, round((CASE WHEN m < 10 THEN pos0 ELSE px END) + 1, 6) AS position, round((CASE WHEN m < 10 THEN value / 10000.0::DOUBLE ELSE pv END) * 100, 7) AS percent FROM q WHERE m < 10 OR i >= 10""")
def grouped_profiles(s, d):
    at = A.observations(s, d).join(A.index(s, d).select("row_id", "chrom", "pos0"), "row_id")
    p = reports.grouped_profile(at, Q._category(s, d), 10, by=("chrom",))
    return p.withColumns({"position": F.round("position", 6), "percent": F.round("percent", 7)})


@query(f"""WITH {BIN}, {CAT}, lab AS (SELECT DISTINCT sample_id, trim(category) AS category FROM cat WHERE trim(category) <> ''), sz AS (SELECT category, count(*) AS n FROM lab GROUP BY 1)
SELECT assay, haplotype, strand, category || ' (n=' || any_value(n) || ')' AS label, chrom, bin, round(sum(value)::DOUBLE / count(*) / 10000.0, 9) AS fraction FROM bins JOIN lab USING (sample_id) JOIN sz USING (category) GROUP BY assay, haplotype, strand, category, chrom, bin""")
def heatmap_groups(s, d):
    bins = matrix.bin_mean(A.observations(s, d), A.index(s, d), 100000)
    return reports.heatmap_groups(bins, Q._category(s, d)).withColumn("fraction", F.round("fraction", 9))


@query(f"""WITH {PAIR}, k AS (SELECT sample_id, count(*) AS n_paired, (sum(p) - sum(m))::DOUBLE / count(*) / 10000 AS mean_diff FROM pm GROUP BY 1)
SELECT sample_id, n_paired, round(mean_diff, 9) AS mean_diff, row_number() OVER (ORDER BY mean_diff, sample_id) AS sample_rank FROM k""")
def bias_ranks(s, d):
    r = reports.bias_ranks(strand.sample_metrics(Q._pairs(s, d)))
    return r.select("sample_id", "n_paired", (F.round(F.col("mean_diff") + 0.0, 9)).alias("mean_diff"), "sample_rank")


@query(f"""WITH {Q.CLU}, ra AS (SELECT representative_row_id, row_number() OVER (ORDER BY max_score DESC, max_abs_mean_diff DESC, n_cpgs DESC, chrom, cluster_start) AS rank FROM clu) SELECT * FROM ra WHERE rank <= 80""")
def hotspot_heatmap_rows(s, d):
    return reports.heatmap_rows(strand.ranked_clusters(Q._clusters(s, d), 500)).select("representative_row_id", "rank")
