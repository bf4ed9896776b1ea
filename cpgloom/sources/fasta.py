"""Motif positions in sequences, and the site index of a FASTA file."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import keep

#: Bytes of a contig that one task scans.
CHUNK = 16 << 20


def motif_positions(df: DataFrame, key: str, text: str, motif: str) -> DataFrame:
    """0-based positions (in characters) of a motif that cannot overlap itself, for every row of ``df``. Null
    texts give none; rows with equal keys stay apart. Time is linear in the text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                p = t.find(motif) if t else -1
                while p >= 0:
                    at.append(i)
                    found.append(p)
                    p = t.find(motif, p + len(motif))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.int64())], names=[key, "pos0"])

    src = df.where(F.contains(F.col(f"`{text}`"), F.lit(motif))).select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    return src.mapInArrow(find, f"`{key}` {df.schema[key].dataType.simpleString()}, pos0 long")


def number_sites(sites: DataFrame) -> DataFrame:
    """Add dense ``row_id`` from 0 in order of (chrom_ord, pos0): ranks within a chromosome plus the counts of
    those before it, so no task sees all sites."""
    per = sites.groupBy("chrom_ord").agg(F.count(F.lit(1)).alias("k"))
    before = Window.orderBy("chrom_ord").rowsBetween(Window.unboundedPreceding, -1)  # one row per chromosome
    off = per.select("chrom_ord", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("off"))
    rank = F.row_number().over(Window.partitionBy("chrom_ord").orderBy("pos0"))
    x = sites.withColumn("rank", rank).join(F.broadcast(off), "chrom_ord")
    return x.withColumn("row_id", (F.col("off") + F.col("rank") - 1).cast("long")).select("row_id", *sites.columns)


def contigs(path: str) -> list[tuple[str, int, int, int]]:
    """(name, order, first byte, last byte) of every record; one sequential scan for ``>``."""
    out: list[list] = []
    at = 0
    with open(path, "rb") as f:
        for line in f:
            if line.startswith(b">"):
                if out:
                    out[-1][3] = at
                words = line[1:].split()
                out.append([words[0].decode() if words else "", len(out), at + len(line), at])
            at += len(line)
    if out:
        out[-1][3] = at
    return [tuple(x) for x in out]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions of CG in a byte range of a contig, as letters counted from the start of the range. One
    letter more is read, so that a motif across the boundary belongs to the earlier range."""
    for batch in batches:
        for r in batch.to_pylist():
            with open(r["path"], "rb") as f:
                f.seek(r["a"])
                data = f.read(r["b"] - r["a"])
                seq = data.translate(None, b"\r\n \t").upper()
                n = len(seq)
                if r["b"] < r["end"]:
                    seq += f.read(min(1024, r["end"] - r["b"])).translate(None, b"\r\n \t").upper()[:1]
            found, i = [], seq.find(b"CG")
            while i >= 0:
                found.append(i)
                i = seq.find(b"CG", i + 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["chrom"]], pa.string()),
                    pa.array([r["chrom_ord"]], pa.int32()),
                    pa.array([r["part"]], pa.int32()),
                    pa.array([n], pa.int64()),
                    pa.array([found], pa.list_(pa.int64())),
                ],
                names=["chrom", "chrom_ord", "part", "letters", "found"],
            )


def build_index(spark: SparkSession, path: str, sex: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``row_id, chrom, chrom_ord, pos0`` of the CG sites of chr1..22 (and X, Y with ``sex``), in the
    order of the FASTA records. Contigs are scanned in chunks by as many tasks."""
    wanted = {f"chr{i}" for i in [*range(1, 23), *(["X", "Y"] if sex else [])]}
    rows, order = [], 0
    for name, _, a, b in contigs(os.path.abspath(path)):
        if name not in wanted:
            continue
        for part, at in enumerate(range(a, max(b, a + 1), chunk)):
            rows.append((os.path.abspath(path), name, order, part, at, min(at + chunk, b), b))
        order += 1
    schema = "path string, chrom string, chrom_ord int, part int, a long, b long, end long"
    jobs = spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 4096)), "chrom", "part")
    got = keep(jobs.mapInArrow(_scan, "chrom string, chrom_ord int, part int, letters long, found array<long>"))
    before = Window.partitionBy("chrom_ord").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = got.select("chrom_ord", "part", F.coalesce(F.sum("letters").over(before), F.lit(0)).alias("base"))  # one row per chunk
    flat = got.join(base, ["chrom_ord", "part"]).select("chrom", "chrom_ord", "base", F.explode("found").alias("p"))
    return number_sites(flat.select("chrom", "chrom_ord", (F.col("base") + F.col("p")).cast("int").alias("pos0")))
