"""Cells per second of writing, grouping and de novo discovery over a dense view; prints one JSON line.

BENCH_ROWS sites x BENCH_SAMPLES samples of pseudo-random values on local[BENCH_CPUS], in a folder that is
removed afterwards. Comparable with published figures in order of magnitude only.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from cpgloom.functions.codec import TrackKey  # noqa: E402
from cpgloom.operators import grouping, matrix  # noqa: E402
from cpgloom.session import get_session  # noqa: E402
from cpgloom.sources import store  # noqa: E402


def main() -> None:
    n_rows, n_samples = int(os.environ.get("BENCH_ROWS", "200000")), int(os.environ.get("BENCH_SAMPLES", "294"))
    spark, folder = get_session("bench_dense"), tempfile.mkdtemp(prefix="cpgloom-dense-")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    took: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - began, 2)

    try:
        gap = F.when(F.col("id") % 7 < 5, 6).otherwise(100)
        rows = spark.range(n_rows).select(F.col("id").alias("row_id"), F.concat(F.lit("chr"), F.expr(f"id div {-(-n_rows // 4)} + 1").cast("string")).alias("chrom"), F.expr(f"cast(id div {-(-n_rows // 4)} as int)").alias("chrom_ord"), (F.col("id") * 206 + gap).cast("int").alias("pos0"))
        rows.write.parquet(f"{folder}/index")
        index = spark.read.parquet(f"{folder}/index")
        cells = spark.range(0, n_rows * n_samples, 1, 32).select(
            F.lit("5mC").alias("assay"), F.lit("combined").alias("haplotype"), F.lit("combined").alias("strand"),
            F.concat(F.lit("chr"), F.expr(f"(id div {n_samples}) div {-(-n_rows // 4)} + 1").cast("string")).alias("chrom"),
            F.expr(f"id div {n_samples}").alias("row_id"), F.concat(F.lit("s"), F.expr(f"id % {n_samples}").cast("string")).alias("sample_id"),
            F.pmod(F.hash("id"), F.lit(10001)).alias("value"),
        )
        cols = [{"assay": "5mC", "haplotype": "combined", "strand": "combined", "sample_id": f"s{i}", "platform": "", "bundle_path": ""} for i in range(n_samples)]
        key = TrackKey("5mC", "combined", "combined")
        timed("write_cohort", lambda: store.write_cohort(cells, cols, f"{folder}/c", "i"))
        groups = grouping.distance_groups(index, gap=250, min_rows=2)
        run = lambda df: df.write.format("noop").mode("overwrite").save()
        run(matrix.group_mean(store.scan(spark, f"{folder}/c").where("chrom = 'chr1'"), grouping.group_members(groups)))  # warm
        timed("group_mean", lambda: run(matrix.group_mean(store.scan(spark, f"{folder}/c"), grouping.group_members(groups))))
        timed("denovo_groups", lambda: run(grouping.correlated_groups(index, store.scan_view(spark, f"{folder}/c", key), 0.1, 400, 3)))
        n = n_rows * n_samples
        print(json.dumps({"cells": n, "cpus": spark.sparkContext.defaultParallelism, "seconds": took, "million_cells_per_second": {k: round(n / v / 1e6, 2) for k, v in took.items()}}))
    finally:
        shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
