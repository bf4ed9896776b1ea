"""Command line: ``python -m cpgloom.cli <command> ...``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .functions.codec import TrackKey
from .sources.inputs import expand as _expand


def _view(p: argparse.ArgumentParser) -> None:
    p.add_argument("--assay", default="5mC")
    p.add_argument("--haplotype", default="combined")
    p.add_argument("--strand", default="combined")


def _select(p: argparse.ArgumentParser, assay: str, rest: str = "combined") -> None:
    p.add_argument("--assay", default=assay)
    p.add_argument("--haplotype", default=rest)
    p.add_argument("--strand", default=rest)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cpgloom")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *required: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for r in required:
            p.add_argument(f"--{r}", required=True)
        return p

    add("index", "reference", "output").add_argument("--sex", action="store_true")
    p = add("create", "index", "bed", "output")
    p.add_argument("--input-format", choices=["modkit", "pacbio", "methbat"], default="modkit")
    p.add_argument("--sample-id")
    p.add_argument("--min-coverage", type=int, default=5)
    p.add_argument("--overwrite", action="store_true")
    p = add("merge", "output")
    p.add_argument("--inputs", nargs="+", required=True)
    p.add_argument("--modified", action="store_true")
    p = add("append", "cohort")
    p.add_argument("--inputs", nargs="+", required=True)
    p.add_argument("--modified", action="store_true")
    p = add("query", "store", "index", "sample-id")
    _view(p)
    p.add_argument("--locus")
    p.add_argument("--region")
    p = add("group", "cohort", "index", "output")
    _view(p)
    p.add_argument("--method", choices=["denovo", "decode", "loyfer"], default="denovo")
    p.add_argument("--intervals")
    p.add_argument("--correlation", type=float, default=0.8)
    p.add_argument("--gap", type=int, default=200)
    p.add_argument("--shared", type=int, default=3)
    p.add_argument("--min-observed", type=int, default=1)
    p.add_argument("--min-rows", type=int, default=2)
    p.add_argument("--definitions", help="folder of stored definitions")
    p.add_argument("--write-table", action="store_true")
    p.add_argument("--overwrite", action="store_true")
    p = add("define", "output")
    p.add_argument("--method", choices=["loyfer", "decode"], required=True)
    p.add_argument("--table", help="block table (loyfer)")
    p.add_argument("--index", help="site index (decode)")
    p.add_argument("--assembly", default="")
    p.add_argument("--citation", default="")
    p = add("matrices", "index", "list", "prefix")
    p.add_argument("--platform", choices=["ont", "pacbio"], default="ont")
    p.add_argument("--min-coverage", type=int, default=0)
    p.add_argument("--percent", action="store_true")
    p = add("matrix", "cohort", "output")
    _view(p)
    p = add("export", "cohort", "index", "output")
    _view(p)
    p.add_argument("--samples", nargs="*")
    p.add_argument("--sample-file")
    p.add_argument("--sample-map")
    p.add_argument("--region")
    p.add_argument("--min-present", type=float, default=1.0)
    p.add_argument("--missing", choices=["drop", "mean"], default="drop")
    p.add_argument("--overwrite", action="store_true")
    p = add("pca", "cohort", "output")
    p.add_argument("--index")
    p.add_argument("--metadata")
    p.add_argument("--umap", action="store_true")
    p.add_argument("--umap-neighbors", type=int, default=15)
    p.add_argument("--umap-min-dist", type=float, default=0.1)
    p.add_argument("--umap-metric", default="euclidean")
    p.add_argument("--outlier-pcs", type=int, default=10)
    _view(p)
    p.add_argument("--n-pcs", type=int, default=10)
    p.add_argument("--min-present", type=float, default=0.8)
    p.add_argument("--fraction", type=float, default=0.1)
    p.add_argument("--bed")
    p.add_argument("--aggregate", action="store_true")
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--alpha", type=float, default=0.999)
    p = add("segments", "output")
    p.add_argument("--inputs", nargs="+", required=True)
    p.add_argument("--mode", choices=["dmr_location", "metric"], default="dmr_location")
    p.add_argument("--metric", default="effect_size")
    p.add_argument("--merge-gap", type=int, default=0)
    p.add_argument("--exclude-sex", action="store_true")
    p.add_argument("--min-samples", type=int, default=2)
    p.add_argument("--min-fraction", type=float, default=0.1)
    p.add_argument("--n-pcs", type=int, default=10)
    p.add_argument("--regions", help="BED file of regions instead of the union")
    p.add_argument("--metadata")
    p = add("stats", "cohort", "index", "output")
    _select(p, "all", "all")
    p.add_argument("--metadata")
    p = add("bins", "cohort", "index", "output")
    _select(p, "5mC,5hmC")
    p.add_argument("--bin-length", type=int, required=True)
    p = add("profile", "cohort", "index", "output", "region")
    _select(p, "5mC,5hmC")
    p.add_argument("--samples", nargs="*")
    p.add_argument("--sample-file")
    p.add_argument("--metadata")
    p.add_argument("--group-by")
    p.add_argument("--combine", choices=["none", "sum", "mean"], default="none")
    p.add_argument("--window", type=int, default=20)
    p.add_argument("--min-points", type=int, default=3)
    p = add("strand", "cohort", "index", "output")
    p.add_argument("--assay", default="5hmC")
    p.add_argument("--haplotype", default="combined")
    p.add_argument("--fraction", type=float, default=0.8)
    p.add_argument("--min-total", type=float, default=0.005)
    p.add_argument("--gap", type=int, default=1000)
    p.add_argument("--min-cpgs", type=int, default=1)
    p.add_argument("--top-n", type=int, default=500)
    p.add_argument("--metadata")
    p.add_argument("--group-by")
    p = add("atlas", "matrix", "row-index", "samples", "output")
    p.add_argument("--cohorts", nargs="*", default=[])
    p.add_argument("--assay", default="modifiedC")
    return top


def _write(df, folder: str, name: str) -> None:
    """A result table as a folder of tab-separated text."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(os.path.join(folder, name))


def _category(spark, a):
    """``sample_id, category`` of the metadata field to group by, or None."""
    from .sources import beds

    if bool(a.metadata) != bool(a.group_by):
        raise ValueError("--metadata and --group-by go together")
    return beds.read_metadata(spark, a.metadata).selectExpr("sample_id", f"trim(`{a.group_by}`) AS category").where("category <> ''").distinct() if a.metadata else None


def run(argv: list[str] | None = None, spark=None):
    a = parser().parse_args(argv)
    from .plans import commands as c
    from .session import get_session
    from .sources import beds, definitions, inputs

    spark = spark or get_session("cpgloom")
    key = TrackKey(a.assay, a.haplotype, a.strand) if hasattr(a, "strand") else None
    sel = (a.assay, a.haplotype, a.strand) if hasattr(a, "strand") else None
    match a.command:
        case "index":
            c.build_index(spark, a.reference, a.output, a.sex)
        case "create":
            r = c.create(spark, a.index, a.bed, a.output, a.sample_id, a.input_format, a.min_coverage, a.overwrite)
            if r is not None:
                print(json.dumps([x.asDict() for x in r.collect()]))
        case "merge":
            c.merge(spark, _expand(a.inputs), a.output, a.modified)
        case "append":
            c.append(spark, a.cohort, _expand(a.inputs), a.modified)
        case "query":
            out = c.query(spark, a.store, a.index, a.sample_id, a.locus, a.region, key)
            print(json.dumps(out))
            return out
        case "group":
            iv = beds.read_regions(spark, a.intervals) if a.intervals else None
            if iv is not None:
                from pyspark.sql import functions as F

                iv = iv.withColumn("region_id", F.xxhash64("chrom", "start", "end"))
            print(json.dumps(c.group(spark, a.cohort, a.index, a.output, a.method, iv, key, a.correlation, a.gap, a.shared, a.min_observed, a.min_rows, 0, a.write_table, a.overwrite, a.definitions)))
        case "define":
            note = {"assembly": a.assembly, "citation": a.citation}
            if a.method == "loyfer":
                definitions.build_blocks(spark, a.table, a.output, **note)
            else:
                definitions.build_units(c.load_index(spark, a.index), a.output, **note)
        case "matrices":
            print(json.dumps(c.dense_matrices(spark, a.index, a.list, a.prefix, a.platform, a.min_coverage, a.percent)))
        case "matrix":
            c.export_matrix(spark, a.cohort, a.output, key)
        case "export":
            rename = None
            if a.sample_map:
                with open(a.sample_map) as f:
                    lines = [x.rstrip("\n").split("\t") for x in f if x.strip()]
                if lines[0] != ["sample_id", "genotype_id"]:
                    raise ValueError("the sample map needs the columns sample_id and genotype_id")
                rename = dict(lines[1:])
            print(json.dumps(c.export_phenotypes(spark, a.cohort, a.index, a.output, key, inputs.split_values(a.samples, a.sample_file), rename, a.region, a.min_present, a.missing, a.overwrite)))
        case "pca":
            meta = beds.read_metadata(spark, a.metadata) if a.metadata else None
            options = {"n_neighbors": a.umap_neighbors, "min_dist": a.umap_min_dist, "metric": a.umap_metric} if a.umap else None
            c.pca(spark, a.cohort, a.index, a.output, key, a.n_pcs, a.min_present, a.fraction, a.seed, a.bed, a.alpha, a.outlier_pcs, a.aggregate, options, meta)
        case "segments":
            meta = beds.read_metadata(spark, a.metadata) if a.metadata else None
            regions = beds.read_regions(spark, a.regions) if a.regions else None
            c.segments_pca(spark, inputs.find_segments(a.inputs), a.output, regions, a.mode, a.metric, a.min_samples, a.min_fraction, a.n_pcs, a.merge_gap, a.exclude_sex, meta)
        case "stats":
            meta = beds.read_metadata(spark, a.metadata) if a.metadata else None
            for name, df in c.stats(spark, a.cohort, c.load_index(spark, a.index).count(), sel, meta).items():
                _write(df, a.output, name)
        case "bins":
            os.makedirs(a.output, exist_ok=True)
            _write(c.binned(spark, a.cohort, a.index, a.bin_length, sel, os.path.join(a.output, "bins.html"), os.path.join(a.output, "binned_profiles.npz")), a.output, "bins")
        case "profile":
            os.makedirs(a.output, exist_ok=True)
            _write(c.profile(spark, a.cohort, a.index, a.region, sel, inputs.split_values(a.samples, a.sample_file), a.combine, a.window, a.min_points, os.path.join(a.output, "profile.html"), _category(spark, a)), a.output, "profile")
        case "strand":
            out = c.strand_bias(spark, a.cohort, a.index, a.assay, a.haplotype, a.fraction, a.min_total, a.gap, a.min_cpgs, a.top_n, _category(spark, a))
            for name, df in out.items():
                _write(df, a.output, name)
            c.write_hotspots(out, a.output, a.group_by or "category")
        case "atlas":
            c.atlas(spark, a.matrix, a.row_index, a.samples, _expand(a.cohorts) if a.cohorts else [], a.output, a.assay)
    return None


if __name__ == "__main__":
    run(sys.argv[1:])
