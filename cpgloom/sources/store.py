"""Parquet stores: sample bundles, cohorts with views and rosters, grouped cohorts."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import TrackKey
from ..operators.matrix import ROSTER_LIMIT, VIEW, each_sample, merge_modified

PARTS = ["assay", "haplotype", "strand", "chrom"]
MANIFEST = "manifest.json"
#: Fixed: the columns of stored observations; a cohort keeps the first four as folders of a batch.
BUNDLE_SCHEMA = "assay string, haplotype string, strand string, chrom string, row_id long, sample_id string, value int, coverage int"
COHORT_SCHEMA = "row_id long, sample_id string, value int, batch string, assay string, haplotype string, strand string, chrom string"


def _write(df: DataFrame, path: str, order: list[str], folders: bool) -> None:
    """Sorted files of about equal size: ranges of (track, chromosome, row) are cut by sampling, so that a
    large track is written by many tasks."""
    keys = [*PARTS, *order]
    w = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("compression", "zstd")
    (w.partitionBy(*PARTS) if folders else w).parquet(path)


def _replace(path: str, write, overwrite: bool) -> None:
    """Let ``write`` fill a folder beside the target and rename it, so that a failure leaves an existing store
    as it was."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        os.makedirs(tmp)
        write(tmp)
        if os.path.exists(path):
            shutil.rmtree(path)
        os.rename(tmp, path)
    finally:
        shutil.rmtree(tmp, ignore_errors=True)


def _manifest(path: str, **values) -> None:
    tmp = os.path.join(path, f".{MANIFEST}.{uuid.uuid4().hex}")
    with open(tmp, "w") as f:
        json.dump({"format_version": "1.0", **values}, f, indent=1, sort_keys=True)
    os.replace(tmp, os.path.join(path, MANIFEST))


def read_manifest(path: str) -> dict:
    with open(os.path.join(path, MANIFEST)) as f:
        return json.load(f)


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def write_bundle(obs: DataFrame, path: str, sample_id: str, platform: str, index_id: str, overwrite: bool = False, source: str = "", summary: dict | None = None) -> None:
    """One sample's tracks in files ordered by track, chromosome and row. ``summary`` is kept beside them."""

    def write(tmp: str) -> None:
        rows = obs.withColumn("sample_id", F.lit(sample_id))
        have = set(rows.columns)
        rows = rows.select(*[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in BUNDLE_SCHEMA.split(", "))])
        _write(rows, os.path.join(tmp, "obs"), ["row_id"], False)
        kept = obs.sparkSession.read.schema(BUNDLE_SCHEMA).parquet(os.path.join(tmp, "obs"))
        counts = kept.groupBy(*VIEW).count().collect()  # one row per track
        _manifest(tmp, kind="bundle", sample_id=sample_id, platform=platform, index_id=index_id, source=source, created_at=_now(),
                  tracks=sorted(({"view": str(TrackKey(r["assay"], r["haplotype"], r["strand"])), "n_obs": r["count"]} for r in counts), key=lambda x: x["view"]))
        if summary is not None:
            with open(os.path.join(tmp, "import_summary.json"), "w") as f:
                json.dump(summary, f, indent=1)

    _replace(path, write, overwrite)


def _entries(bundles: list[str]) -> tuple[list[dict], str]:
    found = [(b, read_manifest(b)) for b in bundles]
    ids = {m["index_id"] for _, m in found}
    if len(ids) != 1:
        raise ValueError(f"bundles of different indexes: {sorted(ids)}")
    cols, seen = [], set()
    for b, m in found:
        for t in m["tracks"]:
            key = (t["view"], m["sample_id"])
            if key in seen:
                raise ValueError(f"sample {key[1]} occurs twice in {key[0]}")
            seen.add(key)
            k = TrackKey.parse(t["view"])
            cols.append({"assay": k.assay, "haplotype": k.haplotype, "strand": k.strand, "sample_id": m["sample_id"], "platform": m["platform"], "bundle_path": b})
    return cols, ids.pop()


def bundle_observations(spark: SparkSession, bundles: list[str]) -> DataFrame:
    """Observations of any number of bundles by one scan."""
    return spark.read.schema(BUNDLE_SCHEMA).parquet(*[os.path.join(b, "obs") for b in bundles])


def _with_modified(obs: DataFrame, cols: list[dict]) -> tuple[DataFrame, list[dict]]:
    """Add the merged view of both assays, for the samples of either."""
    merged = merge_modified(obs, keep=("chrom",)).select(*PARTS, "row_id", "sample_id", "value")
    seen: dict = {}
    for c in cols:
        if c["assay"] in ("5mC", "5hmC"):
            seen.setdefault((c["haplotype"], c["strand"], c["sample_id"]), c | {"assay": "modifiedC"})
    return obs.select(*PARTS, "row_id", "sample_id", "value").unionByName(merged), cols + list(seen.values())


def merge_bundles(spark: SparkSession, bundles: list[str], path: str, overwrite: bool = False, modified: bool = False) -> None:
    """Cohort of several bundles; columns keep the order of the bundles."""
    cols, index_id = _entries(bundles)
    obs = bundle_observations(spark, bundles)
    if modified:
        obs, cols = _with_modified(obs, cols)
    write_cohort(obs, cols, path, index_id, overwrite)


def write_cohort(obs: DataFrame, columns: list[dict], path: str, index_id: str, overwrite: bool = False, representation: str = "cpgs", extra=None) -> None:
    """A cohort of one batch. ``extra`` may write more into the folder before it is published."""

    def write(tmp: str) -> None:
        batch = _write_batch(obs, tmp)
        if extra is not None:
            extra(tmp)
        _manifest(tmp, kind="cohort", index_id=index_id, representation=representation, columns=columns, batches=[batch], created_at=_now())

    _replace(path, write, overwrite)


def _write_batch(obs: DataFrame, path: str) -> str:
    batch = uuid.uuid4().hex
    _write(obs.select(*PARTS, "row_id", "sample_id", "value"), os.path.join(path, "obs", f"batch={batch}"), ["row_id", "sample_id"], True)
    return batch


def _add_batch(path: str, m: dict, obs: DataFrame, columns: list[dict]) -> None:
    """Write a batch into a folder of its own, then name it and its columns in the manifest. What a failed
    attempt left behind is named nowhere and never read, so an attempt may be repeated."""
    batch = _write_batch(obs, path)
    m = {k: v for k, v in m.items() if k != "format_version"}
    _manifest(path, **m | {"columns": m["columns"] + columns, "batches": m["batches"] + [batch], "changed_at": _now()})


def append_bundles(spark: SparkSession, path: str, bundles: list[str], modified: bool = False) -> None:
    """New samples go last in their views; ``modified`` also extends the merged view. Readers see the new
    columns only once the manifest names them."""
    m = read_manifest(path)
    cols, index_id = _entries(bundles)
    if index_id != m["index_id"]:
        raise ValueError("the bundles belong to another index")
    obs = bundle_observations(spark, bundles)
    if modified:
        obs, cols = _with_modified(obs, cols)
    have = {(c["assay"], c["haplotype"], c["strand"], c["sample_id"]) for c in m["columns"]}
    again = [c["sample_id"] for c in cols if (c["assay"], c["haplotype"], c["strand"], c["sample_id"]) in have]
    if again:
        raise ValueError(f"already in the cohort: {sorted(set(again))}")
    _add_batch(path, m, obs, cols)


def add_modified(spark: SparkSession, path: str) -> None:
    """Add the merged view of both assays to a cohort that lacks it."""
    m = read_manifest(path)
    if any(c["assay"] == "modifiedC" for c in m["columns"]):
        raise ValueError("the cohort has a merged view")
    obs, cols = _with_modified(scan(spark, path), m["columns"])
    _add_batch(path, m, obs.where("assay = 'modifiedC'"), cols[len(m["columns"]) :])


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Every observation of the cohort's committed batches; the one way in which a cohort is read."""
    root = os.path.join(path, "obs")
    r = spark.read.schema(COHORT_SCHEMA).option("basePath", root)
    return r.parquet(*[os.path.join(root, f"batch={b}") for b in read_manifest(path)["batches"]]).select(*PARTS, "row_id", "sample_id", "value")


def available_views(path: str) -> list[str]:
    return sorted({str(TrackKey(c["assay"], c["haplotype"], c["strand"])) for c in read_manifest(path)["columns"]})


def view_columns(path: str, key: TrackKey) -> list[dict]:
    return [c for c in read_manifest(path)["columns"] if (c["assay"], c["haplotype"], c["strand"]) == (key.assay, key.haplotype, key.strand)]


def scan_view(spark: SparkSession, path: str, key: TrackKey, chrom: str | None = None) -> DataFrame:
    """Observed cells of the view's committed columns; filters prune partitions."""
    names = [c["sample_id"] for c in view_columns(path, key)]
    if not names:
        raise ValueError(f"no view {key}")
    x = _of_view(scan(spark, path), key, chrom)
    ros = spark.createDataFrame([(n,) for n in names], "sample_id string")
    return x.join(F.broadcast(ros) if len(names) <= ROSTER_LIMIT else ros, "sample_id", "left_semi").select("chrom", "row_id", "sample_id", "value")


def _of_view(obs: DataFrame, key: TrackKey, chrom: str | None = None) -> DataFrame:
    x = obs.where((F.col("assay") == key.assay) & (F.col("haplotype") == key.haplotype) & (F.col("strand") == key.strand))
    return x if chrom is None else x.where(F.col("chrom") == chrom)


def query_point(spark: SparkSession, path: str, index: DataFrame, key: TrackKey, sample_id: str, chrom: str, pos0: int) -> dict | None:
    """A bundle gives None off the index or for a missing cell; a cohort gives None off the index or for an
    unknown sample, and a record without a value for a missing cell."""
    site = index.where((F.col("chrom") == chrom) & (F.col("pos0") == pos0)).select("row_id").first()
    if site is None:
        return None
    m = read_manifest(path)
    out = {"chrom": chrom, "pos0": pos0, "row_id": site["row_id"], "sample_id": sample_id, "percent": None, "fraction": None}
    if m["kind"] == "bundle":
        x = _of_view(bundle_observations(spark, [path]), key, chrom)
        r = x.where(F.col("row_id") == site["row_id"]).select("value", "coverage").first()
        return None if r is None else out | {"percent": r["value"] / 100, "fraction": r["value"] / 10000, "coverage": r["coverage"]}
    if sample_id not in {c["sample_id"] for c in view_columns(path, key)}:
        return None
    r = scan_view(spark, path, key, chrom).where((F.col("row_id") == site["row_id"]) & (F.col("sample_id") == sample_id)).select("value").first()
    return out if r is None else out | {"percent": r["value"] / 100, "fraction": r["value"] / 10000}


def query_range(spark: SparkSession, path: str, index: DataFrame, key: TrackKey, sample_id: str, chrom: str, start: int, end: int) -> DataFrame:
    """Half-open range. A cohort gives every index row, with a null for a missing cell, and no rows for an
    unknown sample or chromosome; a bundle gives its observed rows with their coverage."""
    rows = index.where((F.col("chrom") == chrom) & (F.col("pos0") >= start) & (F.col("pos0") < end)).select("row_id", "chrom", "pos0")
    m = read_manifest(path)
    if m["kind"] == "bundle":
        v = _of_view(bundle_observations(spark, [path]), key, chrom).select("row_id", "value", "coverage")
        return rows.join(v, "row_id").select("row_id", "chrom", "pos0", (F.col("value") / 10000.0).alias("fraction"), "coverage")
    if sample_id not in {c["sample_id"] for c in view_columns(path, key)}:
        return rows.where("false").withColumn("fraction", F.lit(None).cast("double"))
    v = scan_view(spark, path, key, chrom).where(F.col("sample_id") == sample_id).select("row_id", "value")
    return rows.join(v, "row_id", "left").select("row_id", "chrom", "pos0", (F.col("value") / 10000.0).alias("fraction"))


def dense_view(spark: SparkSession, path: str, key: TrackKey, rows: DataFrame) -> DataFrame:
    """Every cell of ``rows`` and the view's roster, null where missing."""
    ros = spark.createDataFrame([(c["sample_id"],) for c in view_columns(path, key)], "sample_id string")
    v = scan_view(spark, path, key).select("row_id", "sample_id", "value")
    return each_sample(rows.select("row_id"), ros).join(v, ["row_id", "sample_id"], "left")
