"""Stored grouping definitions: versioned intervals with their provenance.

A definition is a folder with ``intervals`` (Parquet: per chromosome the distance of each start from the
one before, and the length) and ``definition.json``. Definitions are looked up by method in a given
folder, in the folder that the environment names, and in the package, in this order.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.grouping import distance_groups
from .store import _replace

ENVIRONMENT = "CPGLOOM_DEFINITIONS"
SUFFIX = ".definition"
#: Fixed: bases by which a definition's starts are moved left, and the gap that ends a unit of neighbouring sites.
LEFT_SHIFT = {"loyfer": 1, "decode": 0}
DECODE_GAP = 10
BLOCK_COLUMNS = ("chrom", "start", "end", "start_cpg", "end_cpg")


def encode_starts(intervals: DataFrame) -> DataFrame:
    """``chrom, chrom_ord, i, start_delta, length`` of ``chrom, chrom_ord, start, end``."""
    w = Window.partitionBy("chrom").orderBy("start", "end")
    return intervals.select(
        "chrom", "chrom_ord", F.row_number().over(w).alias("i"),
        (F.col("start") - F.coalesce(F.lag("start").over(w), F.lit(0))).cast("long").alias("start_delta"), (F.col("end") - F.col("start")).cast("long").alias("length"),
    )


def decode_starts(encoded: DataFrame) -> DataFrame:
    """``chrom, chrom_ord, start, end`` again: starts are running sums within their chromosome."""
    w = Window.partitionBy("chrom").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum("start_delta").over(w)
    return encoded.select("chrom", "chrom_ord", start.alias("start"), (start + F.col("length")).alias("end"))


def check_intervals(intervals: DataFrame) -> None:
    """Refuse a definition without intervals, with starts below 0, empty intervals or repeated ones."""
    w = Window.partitionBy("chrom").orderBy("start", "end")
    twice = (F.col("start") == F.lag("start").over(w)) & (F.col("end") == F.lag("end").over(w))
    bad = intervals.withColumn("twice", F.coalesce(twice, F.lit(False))).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("start") < 0) | F.col("start").isNull()).alias("negative"),
        F.count_if(~F.coalesce(F.col("end") > F.col("start"), F.lit(False))).alias("empty"), F.count_if("twice").alias("repeated"),
    ).first()
    if not bad["n"] or bad["negative"] or bad["empty"] or bad["repeated"]:
        raise ValueError(f"not a grouping definition: {bad.asDict()}")


def digest(path: str) -> str:
    """SHA-256 of a file, or of the names and contents of a folder's files in order of their names."""
    h = hashlib.sha256()
    files = [path] if os.path.isfile(path) else sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if not f.startswith((".", "_")))
    for p in files:
        if len(files) > 1:
            h.update(os.path.relpath(p, path).encode() + b"\0")
        with open(p, "rb") as f:
            for block in iter(lambda: f.read(1 << 20), b""):
                h.update(block)
    return h.hexdigest()


def position_digests(index: DataFrame, rows: int = 4096) -> DataFrame:
    """SHA-256 of the positions of each block of ``rows`` index rows: a fingerprint that tasks make apart."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("row_id", "pos0"))), lambda x: x["pos0"].cast("string"))
    return index.groupBy("chrom", F.expr(f"row_id div {rows}").alias("block")).agg(F.sha2(F.array_join(listed, ","), 256).alias("digest"))


def write_definition(intervals: DataFrame, path: str, method: str, version: str = "1", overwrite: bool = False, **provenance) -> None:
    """Store ``chrom, chrom_ord, start, end``; ``provenance`` (assembly, citation, source, ...) is kept."""
    check_intervals(intervals)

    def write(tmp: str) -> None:
        encode_starts(intervals).repartitionByRange("chrom_ord", "i").sortWithinPartitions("chrom_ord", "i").write.option("compression", "zstd").parquet(os.path.join(tmp, "intervals"))
        note = {"method": method, "version": version, "left_shift": LEFT_SHIFT.get(method, 0), "sha256": digest(os.path.join(tmp, "intervals")), **provenance}
        with open(os.path.join(tmp, "definition.json"), "w") as f:
            json.dump(note, f, indent=1, sort_keys=True)

    _replace(path, write, overwrite)


def read_definition(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The intervals and the note; content that does not match its digest is an error."""
    with open(os.path.join(path, "definition.json")) as f:
        note = json.load(f)
    if digest(os.path.join(path, "intervals")) != note["sha256"]:
        raise ValueError(f"{path} was changed since it was written")
    return decode_starts(spark.read.parquet(os.path.join(path, "intervals"))), note


def find_definition(method: str, folder: str | None = None) -> str:
    package = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "resources")
    tried = [d for d in (folder, os.environ.get(ENVIRONMENT), package) if d]
    for d in tried:
        p = os.path.join(d, method + SUFFIX)
        if os.path.isdir(p):
            return p
    raise FileNotFoundError(f"no definition of {method} in {tried}")


def _ordered(rows: DataFrame, key: str) -> DataFrame:
    """``chrom_ord`` from the first place of each chromosome; one row per chromosome is ranked."""
    first = rows.groupBy("chrom").agg(F.min(key).alias("at"))
    order = first.select("chrom", (F.row_number().over(Window.orderBy("at")) - 1).cast("int").alias("chrom_ord"))
    return rows.join(F.broadcast(order), "chrom").select("chrom", "chrom_ord", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def build_blocks(spark: SparkSession, table: str, output: str, method: str = "loyfer", **provenance) -> None:
    """A definition from a headerless table ``chrom start end start_cpg end_cpg``; chromosomes keep the order
    of the table."""
    f = F.split("value", "\t", -1)
    rows = spark.read.text(table).select(F.monotonically_increasing_id().alias("line"), *[f[i].alias(c) for i, c in enumerate(BLOCK_COLUMNS)])
    write_definition(_ordered(rows, "line"), output, method, source=os.path.abspath(table), coordinate_anchor="G", **provenance)


def build_units(index: DataFrame, output: str, method: str = "decode", **provenance) -> None:
    """A definition of units of neighbouring sites, from the site index itself."""
    g = distance_groups(index, DECODE_GAP, 1, method)
    order = index.select("chrom", "chrom_ord").distinct()
    rows = g.join(F.broadcast(order), "chrom").select("chrom", "chrom_ord", "start", "end")  # one row per chromosome
    write_definition(rows, output, method, max_gap=DECODE_GAP, **provenance)
