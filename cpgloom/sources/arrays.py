"""Dense matrix files as a source and a sink: ``<name>.npy`` with a sample list and optional row index."""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Preferred matrices of a folder, best first.
PREFERRED = ("modifiedC", "5mC", "5hmC")
#: Rows of a matrix that one task reads or clears.
ROWS_PER_TASK = 65536


def matrix_file(folder: str) -> str:
    for name in PREFERRED:
        p = os.path.join(folder, f"{name}.npy")
        if os.path.isfile(p):
            return p
    raise FileNotFoundError(f"no matrix in {folder}")


def folder_samples(folder: str) -> list[str]:
    """Sample names of a matrix folder: ``columns.tsv`` (in order of ``col_idx``, named by the last part of
    ``mdb_dir``, else as in ``sample_list``) or ``columns.txt`` (a path or name per line)."""
    tsv = os.path.join(folder, "columns.tsv")
    if not os.path.isfile(tsv):
        with open(os.path.join(folder, "columns.txt")) as f:
            return [os.path.basename(x.strip().rstrip("/")) for x in f if x.strip()]
    t = pd.read_csv(tsv, sep="\t", dtype=str)
    if {"col_idx", "mdb_dir"} <= set(t.columns):
        t = t.iloc[t["col_idx"].astype(int).argsort(kind="stable")]
        return [os.path.basename(x.rstrip("/")) for x in t["mdb_dir"]]
    return sample_list(tsv)


def sample_list(path: str) -> list[str]:
    """Sample ids of a ``columns.tsv`` (column sample_id, else the first) or a plain list."""
    with open(path) as f:
        lines = [x.rstrip("\r\n") for x in f if x.strip()]
    head = lines[0].split("\t") if lines else []
    if "sample_id" in head:
        i = head.index("sample_id")
        return [x.split("\t")[i] for x in lines[1:]]
    return [x.split("\t")[0] for x in lines]


def read_matrix(spark: SparkSession, npy: str, samples: list[str], rows_per_task: int = ROWS_PER_TASK, tolerance: float = 1e-6) -> DataFrame:
    """``row_id, sample_id, value`` of the finite cells of a rows x samples matrix of fractions (or its
    transpose). Tasks map the file and read their own rows; it must lie on storage they share."""
    shape = np.load(npy, mmap_mode="r").shape
    if len(shape) != 2 or len(samples) not in shape:
        raise ValueError(f"shape {shape} does not fit {len(samples)} samples")
    turned = shape[1] != len(samples)
    n = shape[1] if turned else shape[0]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.load(npy, mmap_mode="r")
        names = np.array(samples, dtype=object)
        for b in batches:
            for lo in b["lo"]:
                part = np.asarray(m[:, lo : lo + rows_per_task].T if turned else m[lo : lo + rows_per_task], dtype=float)
                r, c = np.nonzero(np.isfinite(part))
                v = part[r, c]
                if len(v) and (v.min() < -tolerance or v.max() > 1 + tolerance):
                    raise ValueError("a fraction lies outside 0..1")
                yield pd.DataFrame({"row_id": r + lo, "sample_id": names[c], "value": np.rint(np.clip(v, 0, 1) * 10000).astype(np.int32)})

    starts = spark.range(0, n, rows_per_task, max(1, min(4096, -(-n // rows_per_task)))).withColumnRenamed("id", "lo")
    return starts.mapInPandas(load, "row_id long, sample_id string, value int")


def read_row_index(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``chrom start end startCpG endCpG``; the row id is the line's number."""
    opener = gzip.open if path.endswith(".gz") else open
    names = ["chrom", "start", "end", "source_row_start", "source_row_end"]
    with opener(path, "rt") as f:
        t = pd.read_csv(f, sep="\t", header=None, names=names, dtype={"chrom": str})
    if (t["end"] <= t["start"]).any() or t.isna().any().any() or t.duplicated(["chrom", "start", "end"]).any():
        raise ValueError(f"{path} is not a row index")
    t.insert(0, "target_row", np.arange(len(t)))
    return spark.createDataFrame(t)


def write_matrix(cells: DataFrame, n_rows: int, samples: list[str], npy: str, dtype: str = "float32", scale: float = 10000.0) -> None:
    """Dense matrix of ``row_id, sample_id, value``; missing cells are NaN. The driver writes the header; tasks
    fill ranges of rows of the mapped file, which must lie on storage they share. A task that runs again
    writes the same cells again."""
    spark = cells.sparkSession
    np.lib.format.open_memmap(npy, mode="w+", dtype=dtype, shape=(n_rows, len(samples))).flush()

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.load(npy, mmap_mode="r+")
        for b in batches:
            for lo in b.column(0).to_pylist():
                m[lo : lo + ROWS_PER_TASK] = np.nan
        m.flush()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], ["done"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.load(npy, mmap_mode="r+")
        for b in batches:
            r, c, v = (x.to_numpy(zero_copy_only=False) for x in b.columns)
            m[r, c] = v / scale
        m.flush()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], ["done"])

    order = spark.createDataFrame(pd.DataFrame({"sample_id": samples, "col": np.arange(len(samples), dtype=np.int32)}), "sample_id string, col int")
    starts = spark.range(0, n_rows, ROWS_PER_TASK, max(1, min(4096, -(-n_rows // ROWS_PER_TASK))))
    starts.mapInArrow(clear, "done long").count()
    rows = cells.join(order, "sample_id").select("row_id", "col", F.col("value").cast("double").alias("value"))
    rows.repartitionByRange("row_id").sortWithinPartitions("row_id").mapInArrow(fill, "done long").count()


def write_row_index(groups: DataFrame, path: str) -> None:
    """Headerless, compressed ``chrom start end startCpG endCpG`` of grouped rows in row order, by their
    reference bounds where they have them; rows stream to one writer."""
    bound = lambda c: F.coalesce(f"reference_{c}", c) if f"reference_{c}" in groups.columns else F.col(c)
    rows = groups.select("group_row", "chrom", bound("start"), bound("end"), "source_row_start", "source_row_end").orderBy("group_row")
    with gzip.open(path, "wt") as f:
        for r in rows.toLocalIterator(prefetchPartitions=True):
            f.write("\t".join(map(str, r[1:])) + "\n")
