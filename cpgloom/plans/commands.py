"""The engine's commands as functions over stores; the command line calls these."""

from __future__ import annotations

import gzip
import json
import os
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.codec import TrackKey
from ..operators import embed, export, grouping, matrix, metadata, reports, segments, strand
from ..operators.ranges import points_covered, points_in_intervals
from ..sources import arrays, beds, definitions, fasta, html, inputs, phenotypes, store

DEFAULT_VIEW = TrackKey("5mC", "combined", "combined")


def build_index(spark: SparkSession, reference: str, output: str, sex: bool = False) -> None:
    fasta.build_index(spark, reference, sex).repartitionByRange("row_id").sortWithinPartitions("row_id").write.parquet(output)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def create(spark, index: str, source: str, output: str, sample_id: str | None = None, input_format: str = "modkit", min_coverage: int = 5, overwrite: bool = False):
    """Import one sample into a bundle; the output may not hold the input."""
    if os.path.abspath(source).startswith(os.path.abspath(output) + os.sep):
        raise ValueError("the output holds the input")
    idx = load_index(spark, index)
    receipt = None
    if input_format == "modkit":
        obs, platform = beds.read_modkit(spark, beds.discover_modkit(source), idx, min_coverage), "ont"
    elif input_format == "pacbio":
        obs, platform = beds.read_pacbio(spark, beds.discover_pacbio(source), idx, min_coverage), "pacbio"
    elif input_format == "methbat":
        obs, receipt = beds.read_methbat(spark, beds.discover_methbat(source)[0], idx, min_coverage)
        platform = "pacbio"
    else:
        raise ValueError(input_format)
    summary = None if receipt is None else {"receipt": [r.asDict() for r in receipt.collect()], "min_coverage": min_coverage}  # one row per track
    store.write_bundle(obs, output, sample_id or codec.sample_id_from_path(source), platform, os.path.abspath(index), overwrite, source, summary)
    return receipt


def merge(spark, bundles: list[str], output: str, modified: bool = False, overwrite: bool = False) -> None:
    store.merge_bundles(spark, bundles, output, overwrite, modified)


def append(spark, cohort: str, bundles: list[str], modified: bool = False) -> None:
    store.append_bundles(spark, cohort, bundles, modified)


def query(spark, path: str, index: str, sample_id: str, locus: str | None = None, region: str | None = None, key: TrackKey = DEFAULT_VIEW) -> dict | None:
    if (locus is None) == (region is None):
        raise ValueError("give a position or a region")
    idx = load_index(spark, index)
    if locus is not None:
        r = codec.parse_locus(locus)
        return store.query_point(spark, path, idx, key, sample_id, r.chrom, r.start)
    r = codec.parse_inclusive_region(region)
    rows = [x.asDict() for x in store.query_range(spark, path, idx, key, sample_id, r.chrom, r.start, r.end).orderBy("row_id").collect()]  # one locus
    return {"count": len(rows), "records": rows}


def group(spark, cohort: str, index: str, output: str, method: str = "denovo", intervals: DataFrame | None = None, key: TrackKey = DEFAULT_VIEW, correlation: float = 0.8,
          gap: int = 200, shared: int = 3, min_observed: int = 1, min_rows: int = 2, left_shift: int = 0, write_table: bool = False, overwrite: bool = False, definition_folder: str | None = None) -> dict:
    """Group rows and write the grouped cohort with every view; the boundaries of one view serve all."""
    idx, provenance = load_index(spark, index), {}
    if method == "denovo":
        g = grouping.correlated_groups(idx, store.scan_view(spark, cohort, key), correlation, gap, shared, min_rows)
    elif method == "decode" and intervals is None and definition_folder is None:
        g = grouping.distance_groups(idx, definitions.DECODE_GAP, min_rows)
    else:
        if intervals is None:
            used = definitions.find_definition(method, definition_folder)
            intervals, note = definitions.read_definition(spark, used)
            intervals, left_shift = segments.number_regions(intervals.select("chrom", "start", "end")), note["left_shift"]
            provenance = {"definition": used, "sha256": note["sha256"], "version": note["version"]}
        else:
            left_shift = left_shift or definitions.LEFT_SHIFT.get(method, 0)
        got = grouping.predefined_groups(idx, intervals, left_shift, min_rows)
        per = got.join(idx.select(F.col("row_id").alias("source_row_start"), "chrom_ord"), "source_row_start")
        g = grouping.number_groups(per, method)
    g = g.persist()
    n_source, summary = idx.count(), grouping.reduction_summary(g, idx.count()).first().asDict()
    if not summary["n_groups"]:
        raise ValueError("no group is left")
    m = store.read_manifest(cohort)
    means = matrix.group_mean(store.scan(spark, cohort), grouping.group_members(g), min_observed)
    rows = means.join(g.select("group_row", "chrom"), "group_row").withColumnRenamed("group_row", "row_id")

    def more(folder: str) -> None:
        g.write.parquet(os.path.join(folder, "groups"))
        if write_table:
            grouping_table(g, os.path.join(folder, "groups.tsv.gz"))
        with open(os.path.join(folder, "grouping_summary.json"), "w") as f:
            json.dump(summary | provenance | {"n_source": n_source, "method": method}, f, indent=1)

    store.write_cohort(rows, m["columns"], output, m["index_id"], overwrite, "cpg_groups", more)
    g.unpersist()
    return summary


def grouping_table(groups: DataFrame, path: str) -> None:
    """The group index as one ordered, compressed table; groups stream to one writer."""
    cols = ["group_id", "chrom", "start", "end", "source_row_start", "source_row_end", "n_rows", *[c for c in ("reference_start", "reference_end") if c in groups.columns]]
    with gzip.open(path, "wt") as f:
        f.write("\t".join(cols) + "\n")
        for r in groups.orderBy("group_row").select(*cols).toLocalIterator(prefetchPartitions=True):
            f.write("\t".join(map(str, r)) + "\n")


def export_phenotypes(spark, cohort: str, index: str, output: str, key: TrackKey = DEFAULT_VIEW, samples: list[str] | None = None, rename: dict[str, str] | None = None,
                      region: str | None = None, min_present: float = 1.0, missing: str = "drop", overwrite: bool = False) -> dict:
    have = [c["sample_id"] for c in store.view_columns(cohort, key)]
    chosen = list(dict.fromkeys(samples)) if samples else have
    unknown = [s for s in chosen if s not in have]
    if unknown:
        raise ValueError(f"unknown samples: {unknown}")
    names = [(rename or {}).get(s, s) for s in chosen]
    if rename is not None and any(s not in rename for s in chosen):
        raise ValueError("the sample map lacks a chosen sample")
    phenotypes.check_names(names)
    grouped = store.read_manifest(cohort)["representation"] == "cpg_groups"
    idx = load_index(spark, index)
    if grouped:
        g = spark.read.parquet(os.path.join(cohort, "groups"))
        ords = idx.select("chrom", "chrom_ord").distinct()
        rows = g.join(F.broadcast(ords), "chrom").select(F.col("group_row").alias("row_id"), "chrom", "chrom_ord", "start", "end", F.col("group_id").alias("phenotype_id"))  # one row per chromosome
    else:
        rows = phenotypes.single_rows(idx)
    total = rows.count()
    if region is not None:
        r = codec.parse_half_open_region(region)
        if not idx.where(F.col("chrom") == r.chrom).limit(1).count():
            raise ValueError(f"unknown chromosome {r.chrom}")
        rows = export.in_region(rows if grouped else rows.withColumn("pos0", F.col("start")), r.chrom, r.start, r.end, grouped)
    view = store.scan_view(spark, cohort, key).select("row_id", "sample_id", "value")
    sel = spark.createDataFrame([(s, i) for i, s in enumerate(chosen)], "sample_id string, col_ord int")
    labels = export.label_rows(rows, view, sel, min_present, missing).persist()
    counts = {r["label"]: r["n_rows"] for r in export.receipt(labels).collect()}
    cells = export.dense_rows(labels, view, sel)
    imputed = cells.agg(F.coalesce(F.sum("imputed"), F.lit(0))).first()[0]
    table = rows.join(export.packed(cells, F.broadcast(sel)), "row_id")
    considered = sum(counts.values())
    note = {"counts": counts, "considered": considered, "outside_region": total - considered, "total": total, "imputed": imputed}
    note["written"] = phenotypes.write_phenotypes(table, names, output, note, overwrite, (cohort,))
    labels.unpersist()
    return note


def _tsv(df, path: str) -> None:
    """A small result (one row per sample, region or hotspot) as one table."""
    df.toPandas().to_csv(path, sep="\t", index=False)


def _params(folder: str, **values) -> None:
    with open(os.path.join(folder, "params.json"), "w") as f:
        json.dump({"written_at": store._now(), **values}, f, indent=1, default=str)


def pca_input(spark, path: str, key: TrackKey) -> tuple[DataFrame, list[str], bool]:
    """(cells, samples, has positions) of a cohort's view or of a folder with a dense matrix. A bundle holds one
    sample and is refused."""
    kind = inputs.kind_of(path)
    if kind == "cohort":
        return store.scan_view(spark, path, key), [c["sample_id"] for c in store.view_columns(path, key)], True
    if kind == "matrix":
        names = arrays.folder_samples(path)
        return arrays.read_matrix(spark, arrays.matrix_file(path), names), names, False
    raise ValueError(f"{path} is a sample bundle; give a cohort" if kind == "bundle" else f"{path} is neither a cohort nor a matrix folder")


def pca(spark, cohort: str, index: str | None, outdir: str, key: TrackKey = DEFAULT_VIEW, n_pcs: int = 10, min_present: float = 0.8, fraction: float = 0.1, seed: int = 1,
        bed: str | None = None, alpha: float = 0.999, outlier_pcs: int = 10, aggregate: bool = False, umap_options: dict | None = None, meta: DataFrame | None = None) -> DataFrame:
    """Embedding of samples; ``aggregate`` uses the means of the BED regions as features, in full precision,
    and writes them. Also writes the outlier tables and, with ``umap_options``, the UMAP coordinates."""
    view, names, placed = pca_input(spark, cohort, key)
    if bed and not placed:
        raise ValueError("rows of a matrix folder have no positions")
    os.makedirs(outdir, exist_ok=True)
    if bed:
        idx, regions = load_index(spark, index), beds.read_regions(spark, bed)
    if bed and aggregate:
        regions = segments.number_regions(regions.select("chrom", "start", "end"))
        hit = points_in_intervals(idx.select("row_id", "chrom", "pos0"), regions).select(F.col("p_row_id").alias("row_id"), F.col("i_region_id").alias("region_id"))
        table = matrix.region_table(view, hit, regions).persist()
        order = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "sample_id string, col_ord int")
        _region_table(table, order, names, os.path.join(outdir, "region_avg.tsv"))
        cells = table.where("fraction IS NOT NULL").select(F.col("region_id").alias("row_id"), "sample_id", "fraction")
        kept = matrix.presence_rows(cells, len(names), min_present).select("row_id").persist()
        n_rows = kept.count()
        z, n_pcs = embed.standardised_fractions(cells.join(kept, "row_id", "left_semi")), max(1, min(n_pcs, n_rows, len(names)))
    else:
        rows = points_covered(idx, regions).select("row_id") if bed else view.select("row_id").distinct()
        kept = matrix.presence_rows(view.join(rows, "row_id", "left_semi"), len(names), min_present)
        kept = (matrix.sample_rows(kept, fraction, seed) if fraction < 1 else kept).select("row_id").persist()
        n_rows = kept.count()
        z = embed.standardised(view, kept, matrix.moments(view, kept))
    x, ratio = embed.pca(z, names, n_pcs)
    kept.unpersist()
    dist, out = embed.mahalanobis(x[:, :outlier_pcs], alpha)
    cols = {"sample_id": names} | {f"PC{k + 1}": x[:, k] for k in range(x.shape[1])}
    if umap_options is not None:
        u = umap(x, random_state=seed, **umap_options)
        cols |= {"UMAP1": u[:, 0], "UMAP2": u[:, 1]}
    t = pd.DataFrame(cols | {"distance": dist, "is_outlier": out, "col_ord": np.arange(len(names))})
    table = spark.createDataFrame(t)
    table = table if meta is None else table.join(meta, "sample_id", "left")
    shown = metadata.shortest_unique_id(table.withColumnRenamed("sample_id", "id"), "id")
    table = table if shown == "id" else table.withColumn("display_id", F.col(shown))
    table.orderBy("col_ord").drop("col_ord").withColumnRenamed("distance", "mahalanobis_pc").toPandas().to_csv(os.path.join(outdir, "embedding.tsv"), sep="\t", index=False, float_format="%.9g")
    for name, df in reports.outlier_tables(table.drop("col_ord")).items():
        _tsv(df, os.path.join(outdir, f"{name}.tsv"))
    pts = [{"name": n, "x": float(x[i, 0]), "y": float(x[i, 1]) if x.shape[1] > 1 else 0.0, "flag": bool(out[i])} for i, n in enumerate(names)]
    html.write_report(os.path.join(outdir, "embedding.html"), "points", "Embedding", {"points": pts, "explained": ratio.tolist()})
    _params(outdir, input=cohort, view=key, n_pcs=n_pcs, min_present=min_present, fraction=fraction, seed=seed, bed=bed, aggregate=aggregate, alpha=alpha, n_rows=n_rows, explained=ratio.tolist())
    return spark.createDataFrame([(n, *map(float, x[i])) for i, n in enumerate(names)], "sample_id string, " + ", ".join(f"pc{k + 1} double" for k in range(x.shape[1])))


def _region_table(table: DataFrame, order: DataFrame, names: list[str], path: str) -> None:
    """Regions with their number of sites and one column per sample, blank where nothing is observed. Rows
    stream to one writer; each holds one value per sample."""
    cells = table.where("sample_id IS NOT NULL").join(order, "sample_id").groupBy("region_id").agg(F.map_from_entries(F.collect_list(F.struct("col_ord", "fraction"))).alias("m"))
    rows = table.select("region_id", "chrom", "start", "end", "n_cpgs").distinct().join(cells, "region_id", "left").orderBy("region_id")
    with open(path, "w") as f:
        f.write("\t".join(["chrom", "start", "end", "n_cpgs", *names]) + "\n")
        for r in rows.toLocalIterator(prefetchPartitions=True):
            m = r["m"] or {}
            f.write("\t".join([r["chrom"], str(r["start"]), str(r["end"]), str(r["n_cpgs"]), *[f"{m[i]:.9g}" if i in m else "" for i in range(len(names))]]) + "\n")


def umap(coordinates, **options):
    """Needs the optional library; everything else works without it."""
    try:
        import umap as library
    except ImportError as e:
        raise RuntimeError("install umap-learn for this embedding") from e
    return library.UMAP(**options).fit_transform(coordinates)


def segments_pca(spark, files: dict[str, str], outdir: str, regions: DataFrame | None = None, mode: str = "dmr_location", metric: str = "effect_size", min_samples: int = 2,
                 min_fraction: float = 0.1, n_pcs: int = 10, merge_gap: int = 0, exclude_sex: bool = False, meta: DataFrame | None = None) -> DataFrame:
    seg = beds.read_segments(spark, files)
    reg = segments.merge_intervals(seg.where("name = 'different'") if regions is None else regions, merge_gap)
    reg = segments.drop_sex_chromosomes(reg) if exclude_sex else reg
    samples = spark.createDataFrame([(s,) for s in files], "sample_id string")
    if mode == "dmr_location":
        cells = segments.project_presence(seg, reg, samples)
        hits = cells.where("value > 0")
    else:
        cells = segments.project_metric(seg, reg, metric)
        hits = cells
    ok = segments.supported_regions(hits, len(files), min_samples, min_fraction)
    z = cells.join(ok.select("region_id"), "region_id").withColumnRenamed("region_id", "row_id").withColumn("v", F.col("value").cast("double"))
    m = z.groupBy("sample_id").agg(F.avg("v").alias("m"), F.coalesce(F.nullif(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("d"))
    names = list(files)
    x, _ = embed.pca(z.join(m, "sample_id").select("row_id", "sample_id", ((F.col("v") - F.col("m")) / F.col("d")).alias("z")), names, min(n_pcs, len(names)))
    os.makedirs(outdir, exist_ok=True)
    out = spark.createDataFrame([(n, *map(float, x[i])) for i, n in enumerate(names)], "sample_id string, " + ", ".join(f"pc{k + 1} double" for k in range(x.shape[1])))
    _tsv(out, os.path.join(outdir, "embedding.tsv"))
    support = reg.join(hits.groupBy("region_id").agg(F.count(F.lit(1)).alias("n_support")), "region_id", "left").withColumn("n_support", F.coalesce("n_support", F.lit(0)))
    labelled = support.join(ok.select("region_id", F.lit(True).alias("used")), "region_id", "left").select(
        F.format_string("DMR%06d", "region_id").alias("region"), "chrom", "start", "end", "n_support", F.coalesce("used", F.lit(False)).alias("used")
    )
    labelled.coalesce(1).sortWithinPartitions("region").write.mode("overwrite").option("sep", "\t").option("header", True).csv(os.path.join(outdir, "regions"))
    if meta is not None:
        order = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "sample_id string, col_ord int")
        own = metadata.select_rows(metadata.fill_broad_tissue(meta), order, "sample_id")
        if own is not None:  # all samples or none
            _tsv(own.orderBy("col_ord").drop("col_ord"), os.path.join(outdir, "metadata.tsv"))
    _params(outdir, inputs=files, mode=mode, metric=metric, min_samples=min_samples, min_fraction=min_fraction, merge_gap=merge_gap, exclude_sex=exclude_sex)
    return out


def dense_matrices(spark, index: str, listing: str, prefix: str, platform: str = "ont", min_coverage: int = 0, percent: bool = False) -> list[str]:
    """Dense 5mC (and, for modkit tables, 5hmC) matrices of the listed files, in fractions or percent. Files
    that are missing are named in a warning and leave a column without values. Returns the files written."""
    idx, named = load_index(spark, index), inputs.named_files(listing)
    if not named:
        raise FileNotFoundError(f"no file in {listing}")
    names = [n for n, _ in named]
    if len(set(names)) != len(names):
        raise ValueError("a sample is listed twice")
    parts = []
    for name, path in named:
        if not os.path.isfile(path):
            warnings.warn(f"missing file {path} of sample {name}", stacklevel=2)
            continue
        one = [beds.InputFile("combined", path)]
        obs = beds.read_modkit(spark, one, idx, min_coverage) if platform == "ont" else beds.read_pacbio(spark, one, idx, min_coverage)
        parts.append(obs.select("assay", "row_id", F.lit(name).alias("sample_id"), "value"))
    n, out = idx.count(), []
    cells = beds._union(parts) if parts else spark.createDataFrame([], "assay string, row_id long, sample_id string, value int")
    for assay in ("5mC", "5hmC") if platform == "ont" else ("5mC",):
        out.append(f"{prefix}.{assay}.npy")
        arrays.write_matrix(cells.where(F.col("assay") == assay).drop("assay"), n, names, out[-1], scale=100.0 if percent else 10000.0)
    return out


def export_matrix(spark, cohort: str, output: str, key: TrackKey = DEFAULT_VIEW) -> None:
    """A grouped view as ``matrix.npy`` with ``matrix.index.gz``, ``samples.txt`` and a note."""
    m = store.read_manifest(cohort)
    names = [c["sample_id"] for c in store.view_columns(cohort, key)]
    if m["representation"] != "cpg_groups" or len(names) < 2:
        raise ValueError("a grouped view of at least two samples is needed")
    os.makedirs(output)
    g = spark.read.parquet(os.path.join(cohort, "groups"))
    n = g.count()
    arrays.write_matrix(store.scan_view(spark, cohort, key), n, names, os.path.join(output, "matrix.npy"))
    arrays.write_row_index(g, os.path.join(output, "matrix.index.gz"))
    with open(os.path.join(output, "samples.txt"), "w") as f:
        f.writelines(f"{x}\n" for x in names)
    with open(os.path.join(output, "export.json"), "w") as f:
        json.dump({"source": os.path.abspath(cohort), "view": str(key), "shape": [n, len(names)], "sample_ids": names, "units": "fraction", "missing": "NaN"}, f, indent=1)


def stats(spark, cohort: str, n_rows: int, selector: tuple[str, str, str] = ("all", "all", "all"), meta: DataFrame | None = None, fields: list[str] | None = None) -> dict[str, DataFrame]:
    cols = spark.createDataFrame(store.read_manifest(cohort)["columns"]).select(*matrix.VIEW, "sample_id")
    obs = store.scan(spark, cohort)
    counts = matrix.observed_counts(matrix.select_tracks(obs, *selector), matrix.select_tracks(cols, *selector))
    out = {"ranks": matrix.sample_rank(counts), "tracks": matrix.track_summary(counts, n_rows)}
    if meta is not None:
        out["groups"] = matrix.metadata_group_summary(counts, meta, fields or [c for c in meta.columns if c != "sample_id"])
    return out


def binned(spark, cohort: str, index: str, width: int, selector: tuple[str, str, str] = ("5mC,5hmC", "combined", "combined"), report: str | None = None, arrays_file: str | None = None) -> DataFrame:
    """Binned profiles of the cohort's own views."""
    obs = matrix.select_tracks(store.scan(spark, cohort), *selector)
    bins = matrix.bin_mean(obs.drop("chrom"), load_index(spark, index), width)
    if arrays_file:
        t = bins.toPandas()  # one report holds one heatmap of samples by bins
        np.savez_compressed(arrays_file, **{c: t[c].to_numpy(dtype=str if t[c].dtype == object else None) for c in t.columns}, bin_length=width)
    if report:
        t = bins.toPandas()  # one report holds one heatmap of samples by bins
        t["col"] = t["chrom"] + ":" + t["bin"].astype(str)
        w = t.pivot_table(index=["assay", "sample_id"], columns="col", values="value")
        cells = [[None if v != v else v / 10000 for v in r] for r in w.to_numpy()]
        html.write_report(report, "heatmap", "Binned methylation", {"rows": [" ".join(map(str, i)) for i in w.index], "columns": list(w.columns), "cells": cells})
    return bins


def profile(spark, cohort: str, index: str, region: str, selector: tuple[str, str, str] = ("5mC,5hmC", "combined", "combined"), samples: list[str] | None = None, combine: str = "none",
            window: int = 20, min_points: int = 3, report: str | None = None, category: DataFrame | None = None) -> DataFrame:
    """Smoothed locus profile of the samples that all selected tracks share, or of their categories."""
    r = codec.parse_inclusive_region(region, commas=True)
    cols = matrix.select_tracks(spark.createDataFrame(store.read_manifest(cohort)["columns"]).select(*matrix.VIEW, "sample_id"), *selector)
    shared = matrix.common_samples(cols, cols.select(*matrix.VIEW).distinct().count())
    if samples:
        shared = shared.where(F.col("sample_id").isin(samples))
    idx = load_index(spark, index).where((F.col("chrom") == r.chrom) & (F.col("pos0") >= r.start) & (F.col("pos0") < r.end))
    obs = matrix.select_tracks(store.scan(spark, cohort).where(F.col("chrom") == r.chrom), *selector).drop("chrom")
    obs = obs.join(shared, "sample_id", "left_semi").join(idx.select("row_id", "pos0"), "row_id")
    if combine != "none":
        both = matrix.combine_tracks(obs, combine).join(idx.select("row_id", "pos0"), "row_id")
        obs = both.select("row_id", "pos0", "sample_id", F.lit("combined").alias("assay"), F.lit("all").alias("haplotype"), F.lit("all").alias("strand"), (F.col("fraction") * 10000).alias("value"))
    if not obs.limit(1).count():
        raise ValueError("no observed value in the region")
    out = matrix.sliding_mean(obs, window, min_points) if category is None else reports.grouped_profile(obs, category, window, min_points)
    if report and category is None:
        t = out.toPandas().sort_values("pos0_mean")  # one locus
        series = [{"name": " ".join(k), "x": g["pos0_mean"].tolist(), "y": g["fraction"].tolist()} for k, g in t.groupby(["assay", "haplotype", "strand", "sample_id"])]
        html.write_report(report, "lines", region, {"series": series})
    return out


def strand_bias(spark, cohort: str, index: str, assay: str = "5hmC", haplotype: str = "combined", fraction: float = 0.8, min_total: float = 0.005, gap: int = 1000, min_cpgs: int = 1,
                top_n: int = 500, category: DataFrame | None = None) -> dict[str, DataFrame]:
    obs = store.scan(spark, cohort).where((F.col("assay") == assay) & (F.col("haplotype") == haplotype)).drop("chrom")
    plus = {c["sample_id"] for c in store.view_columns(cohort, TrackKey(assay, haplotype, "plus"))}
    both = plus & {c["sample_id"] for c in store.view_columns(cohort, TrackKey(assay, haplotype, "minus"))}
    n = len(both)
    if not n:
        raise ValueError("no sample has both strands")
    pairs, idx = strand.paired(obs), load_index(spark, index)
    need = max(1, -int(-(n * fraction) // 1))
    limit = strand.candidate_limit(top_n, min_cpgs)
    best = strand.best_rows(strand.strand_scores(pairs, need, min_total), limit)
    clusters = strand.ranked_clusters(strand.hotspot_clusters(best, idx, gap, min_cpgs), top_n)
    roster = spark.createDataFrame([(x,) for x in sorted(both)], "sample_id string")
    out = {"samples": strand.sample_metrics(pairs), "candidates": best, "clusters": clusters, "sample_profiles": strand.sample_profiles(obs, clusters, roster)}
    if category is not None:
        category = category.join(roster, "sample_id", "left_semi")
        out["categories"] = strand.category_scores(pairs, category, fraction, min_total)
        leading = strand.best_category_rows(out["categories"], limit)
        out["category_clusters"] = strand.ranked_clusters(strand.hotspot_clusters(leading, idx, gap, min_cpgs, ("category",)), top_n, ("category",))
        out["summary"] = strand.category_summary(out["samples"], category)
        out["profiles"] = strand.hotspot_profiles(pairs, clusters, category)
    return out


def write_hotspots(tables: dict[str, DataFrame], folder: str, field: str = "category") -> None:
    """Hotspots of all samples and of each category as tables and BED files; at most the best of each."""
    os.makedirs(folder, exist_ok=True)
    label = codec.thousands_label(F.col("rank"), F.col("chrom"), F.col("cluster_start"), F.col("cluster_end"))

    def put(df: pd.DataFrame, name: str) -> None:
        df.to_csv(os.path.join(folder, f"{name}.tsv"), sep="\t", index=False)
        if len(df):
            df[["chrom", "cluster_start", "cluster_end", "hotspot_label", "max_score", "direction"]].to_csv(os.path.join(folder, f"{name}.bed"), sep="\t", index=False, header=False)

    put(tables["clusters"].withColumn("hotspot_label", label).orderBy("rank").toPandas(), "hotspots_global")
    if "category_clusters" in tables:
        t = tables["category_clusters"].withColumns({"hotspot_label": label, "part__": codec.safe_file_part(F.col("category"))}).orderBy("category", "rank").toPandas()
        for part, df in t.groupby("part__"):
            put(df.drop(columns="part__"), f"hotspots_{field}_{part}")


def atlas(spark, npy: str, row_index: str, samples: str, cohorts: list[str], output: str, assay: str = "modifiedC") -> None:
    """A dense matrix and grouped cohorts in the matrix's row system. A source row without an exact match
    and a view from two sources are errors."""
    names = arrays.sample_list(samples)
    target = arrays.read_row_index(spark, row_index)
    base = arrays.read_matrix(spark, npy, names).join(target.select(F.col("target_row").alias("row_id"), "chrom"), "row_id")
    key = TrackKey(assay, "combined", "combined")
    cols = [{"assay": assay, "haplotype": "combined", "strand": "combined", "sample_id": n, "platform": "matrix", "bundle_path": npy} for n in names]
    out = base.select(F.lit(assay).alias("assay"), F.lit("combined").alias("haplotype"), F.lit("combined").alias("strand"), "chrom", "row_id", "sample_id", "value")
    taken = {str(key)}
    for c in cohorts:
        m = store.read_manifest(c)
        views = set(store.available_views(c))
        if views & taken:
            raise ValueError(f"two sources bring {sorted(views & taken)}")
        taken |= views
        g = spark.read.parquet(os.path.join(c, "groups"))
        g = g.withColumns({"start": F.coalesce(F.col("reference_start"), F.col("start")), "end": F.coalesce(F.col("reference_end"), F.col("end"))}) if "reference_start" in g.columns else g
        aligned = metadata.align_rows(g, target).persist()
        if aligned.where("NOT matched").limit(1).count():
            raise ValueError(f"rows of {c} are missing from the matrix index")
        out = out.unionByName(metadata.remap(store.scan(spark, c), aligned).select(*out.columns))
        cols += m["columns"]
    store.write_cohort(out, cols, output, os.path.abspath(row_index), representation="matrix_rows")
