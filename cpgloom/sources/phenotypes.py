"""The ordered phenotype-matrix file with its receipt."""

from __future__ import annotations

import gzip
import json
import os
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIXED = ("#chr", "start", "end", "phenotype_id")


def check_names(names: list[str]) -> None:
    """Output columns: at least two, unique, without blanks and none of the fixed ones."""
    if len(names) < 2 or len(set(names)) != len(names):
        raise ValueError("at least two different samples are needed")
    for n in names:
        if not re.fullmatch(r"[^\s\0]+", n) or n in FIXED:
            raise ValueError(f"not a column name: {n!r}")


def write_phenotypes(rows: DataFrame, names: list[str], path: str, receipt: dict, overwrite: bool = False, inputs: tuple[str, ...] = ()) -> int:
    """Write ``chrom, chrom_ord, start, end, phenotype_id, fractions`` (array in the order of ``names``) as
    one ordered, optionally compressed table. Rows stream to one writer; nothing is published if there are
    none or anything fails, and an existing file is kept unless ``overwrite``."""
    check_names(names)
    out, note = os.path.abspath(path), os.path.abspath(path) + ".json"
    if any(out.startswith(os.path.abspath(i) + os.sep) for i in inputs):
        raise ValueError("the output lies inside an input store")
    if not overwrite and (os.path.exists(out) or os.path.exists(note)):
        raise FileExistsError(out)
    tmp = f"{out}.{uuid.uuid4().hex}.tmp"
    n = 0
    try:
        opener = gzip.open if out.endswith(".gz") else open
        with opener(tmp, "wt") as f:
            f.write("\t".join([*FIXED, *names]) + "\n")
            for r in rows.orderBy("chrom_ord", "start", "end", "phenotype_id").toLocalIterator(prefetchPartitions=True):
                f.write("\t".join([r["chrom"], str(r["start"]), str(r["end"]), r["phenotype_id"], *[f"{v:.9g}" for v in r["fractions"]]]) + "\n")
                n += 1
        if not n:
            raise ValueError("no row passes the filters")
        with open(tmp + ".json", "w") as f:
            json.dump(receipt | {"written": n, "samples": names}, f, indent=1)
        os.replace(tmp, out)
        os.replace(tmp + ".json", note)
    finally:
        for p in (tmp, tmp + ".json"):
            if os.path.exists(p):
                os.remove(p)
    return n


def single_rows(index: DataFrame) -> DataFrame:
    """Single sites as one-base intervals named by their 1-based position."""
    return index.select(
        "row_id", "chrom", "chrom_ord", F.col("pos0").cast("long").alias("start"), (F.col("pos0") + 1).cast("long").alias("end"),
        F.concat_ws(":", "chrom", (F.col("pos0") + 1).cast("string")).alias("phenotype_id"),
    )
