"""Readers of per-sample methylation tables: modkit, PacBio score files and MethBat pileups.

Each returns observations ``assay, haplotype, strand, chrom, row_id, value, coverage``. Text is read as
lines and split by position; the site index is joined on (chrom, pos0), so positions off the index drop
out. The column layouts and codes below are fixed by the file formats.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import encode_percent, is_finite, reencode_percent, shift_minus

ASSAYS = {"m": "5mC", "h": "5hmC"}
HAPLOTYPES = {"combined": "combined", "hp1": "hap1", "hp2": "hap2", "hap1": "hap1", "hap2": "hap2"}
METHBAT_TYPES = {"Total": "combined", "hap1": "hap1", "hap2": "hap2"}
METHBAT_STRANDS = {".": "combined", "+": "plus", "-": "minus"}
OBS = ["assay", "haplotype", "strand", "chrom", "row_id", "value", "coverage"]


@dataclass(frozen=True)
class InputFile:
    tag: str
    path: str


def _first(*paths: str) -> str | None:
    return next((p for p in paths if os.path.isfile(p)), None)


def _need(files: list[InputFile], path: str) -> list[InputFile]:
    if not files:
        raise FileNotFoundError(f"no input found at {path}")
    return files


def discover_modkit(path: str) -> list[InputFile]:
    """A file; a folder with combined/hp1/hp2.bed[.gz] (compressed preferred); or a prefix."""
    if os.path.isfile(path):
        return [InputFile("combined", path)]
    out = []
    for tag, hap in (("combined", "combined"), ("hp1", "hap1"), ("hp2", "hap2")):
        p = _first(f"{path}/{tag}.bed.gz", f"{path}/{tag}.bed") if os.path.isdir(path) else _first(f"{path}.{hap}.bed.gz", f"{path}.{hap}.bed")
        if p:
            out.append(InputFile(tag, p))
    return _need(out, path)


def discover_pacbio(path: str) -> list[InputFile]:
    """A file; a prefix of <prefix>[.cpg_scores].combined/hap1/hap2.bed[.gz]; or a folder of one prefix."""
    if os.path.isfile(path):
        return [InputFile("combined", path)]
    prefixes = [path, f"{path}.cpg_scores"]
    if os.path.isdir(path):
        names = sorted({n.split(f".{h}.bed")[0] for n in os.listdir(path) for h in ("combined", "hap1", "hap2") if f".{h}.bed" in n})
        if len(names) > 1:
            raise ValueError(f"several samples in {path}: {names}")
        prefixes = [os.path.join(path, n) for n in names]
    out = []
    for h in ("combined", "hap1", "hap2"):
        p = _first(*[f"{x}.{h}.bed{gz}" for x in prefixes for gz in (".gz", "")])
        if p:
            out.append(InputFile(h, p))
    return _need(out, path)


def discover_methbat(path: str) -> tuple[list[InputFile], list[str]]:
    """Pileups of a file or prefix, and the 6mA files that are ignored. Both spellings of one file are an
    error."""
    if os.path.isfile(path):
        return [InputFile("methbat", path)], []
    out, ignored = [], []
    for code in ("5mC", "5hmC", "6mA"):
        found = [p for p in (f"{path}.{code}.bed", f"{path}.{code}.bed.gz") if os.path.isfile(p)]
        if len(found) > 1:
            raise ValueError(f"ambiguous input: {found}")
        if found and code == "6mA":
            ignored += found
        elif found:
            out.append(InputFile(code, found[0]))
    return _need(out, path), ignored


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their order within the file and their tab-separated fields."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.col("value"), F.split("value", "\t", -1).alias("f"))


def _on_index(calls: DataFrame, index: DataFrame) -> DataFrame:
    return calls.join(index.select("chrom", "pos0", "row_id"), ["chrom", "pos0"])


def _deep(df: DataFrame, min_coverage: int) -> DataFrame:
    return df.where(F.col("coverage") >= min_coverage) if min_coverage > 0 else df


def _last_wins(df: DataFrame, min_coverage: int) -> DataFrame:
    """Of several rows at one position the last of the file counts; the stored coverage is the
    threshold."""
    g = df.groupBy("assay", "haplotype", "strand", "chrom", "row_id").agg(F.max_by("value", "line").alias("value"))
    return g.where("value IS NOT NULL").withColumn("coverage", F.lit(max(min_coverage, 0))).select(*OBS)


def is_stranded(lines: DataFrame) -> bool:
    """Does a modkit table hold both strands?"""
    st = F.get("f", F.lit(5))
    r = lines.agg(F.count_if(st == "+").alias("p"), F.count_if(st == "-").alias("m")).first()
    return r["p"] > 0 and r["m"] > 0


def read_modkit(spark: SparkSession, files: list[InputFile], index: DataFrame, min_coverage: int = 5) -> DataFrame:
    """Headerless bedMethyl. Stranded tables give plus and minus tracks (a minus call belongs one base to
    the left, at 0 at least) and no combined one; each file is judged by itself."""
    parts = []
    for x in files:
        lines = _fields(spark, x.path)
        stranded = is_stranded(lines)
        f = lambda i: F.get("f", F.lit(i))
        calls = lines.where(~F.col("value").startswith("#")).select(
            "line", f(0).alias("chrom"), f(1).try_cast("int").alias("start"), f(3).alias("code"), f(5).alias("sign"),
            f(9).try_cast("int").alias("coverage"), f(10).try_cast("double").alias("percent"),
        )
        calls = _deep(calls, min_coverage).where(F.col("code").isin(*ASSAYS) & is_finite(F.col("percent")))
        sign = F.col("sign") if stranded else F.lit("+")
        st = F.when(F.col("sign") == "-", "minus").otherwise("plus") if stranded else F.lit("combined")
        parts.append(calls.select(
            "line", "chrom", shift_minus(F.col("start"), sign, clamp=True).alias("pos0"), F.when(F.col("code") == "m", ASSAYS["m"]).otherwise(ASSAYS["h"]).alias("assay"),
            F.lit(HAPLOTYPES[x.tag]).alias("haplotype"), st.alias("strand"), reencode_percent(F.col("percent")).alias("value"),
        ))
    return _last_wins(_on_index(_union(parts), index), min_coverage)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _header(lines: DataFrame, path: str) -> list[str]:
    h = lines.where(F.col("value").startswith("#chrom")).orderBy("line").select("value").first()
    if h is None:
        raise ValueError(f"no #chrom header in {path}")
    return h["value"].lstrip("#").rstrip("\r").split("\t")


def _column(names: list[str], name: str) -> Column:
    return F.regexp_replace(F.get("f", F.lit(names.index(name))), "\r$", "")


def read_pacbio(spark: SparkSession, files: list[InputFile], index: DataFrame, min_coverage: int = 5) -> DataFrame:
    """Score files with a ``#chrom`` header; the score is discretized_mod_score, else mod_score."""
    parts = []
    for x in files:
        lines = _fields(spark, x.path)
        names = _header(lines, x.path)
        score = next((c for c in ("discretized_mod_score", "mod_score") if c in names), None)
        if score is None or not {"begin", "cov"} <= set(names):
            raise ValueError(f"columns missing in {x.path}: {names}")
        calls = lines.where(~F.col("value").startswith("#")).select(
            "line", _column(names, "chrom").alias("chrom"), _column(names, "begin").try_cast("int").alias("pos0"),
            _column(names, "cov").try_cast("int").alias("coverage"), _column(names, score).try_cast("double").alias("percent"),
        )
        calls = _deep(calls, min_coverage).where(is_finite(F.col("percent")))
        parts.append(calls.select(
            "line", "chrom", "pos0", F.lit("5mC").alias("assay"), F.lit(HAPLOTYPES[x.tag]).alias("haplotype"), F.lit("combined").alias("strand"),
            reencode_percent(F.col("percent")).alias("value"),
        ))
    return _last_wins(_on_index(_union(parts), index), min_coverage)


def read_methbat(spark: SparkSession, files: list[InputFile], index: DataFrame, min_coverage: int = 5) -> tuple[DataFrame, DataFrame]:
    """(observations, receipt). Every row is validated; any violation, a duplicate position or an import
    without a row is an error and nothing is returned. Coverage is stored as read."""
    parts = []
    for x in files:
        lines = _fields(spark, x.path)
        names = _header(lines, x.path)
        missing = {"chrom", "start", "end", "name", "strand", "mod_score", "type", "cov"} - set(names)
        if missing:
            raise ValueError(f"columns missing in {x.path}: {sorted(missing)}")
        meta = lines.where(F.col("value").startswith("##base_modification=")).select("value").first()
        code = meta["value"].split("=", 1)[1].strip() if meta else None
        if code not in ("5mC", "5hmC") or x.tag in ("5mC", "5hmC") and code != x.tag:
            raise ValueError(f"{x.path} holds {code}")
        c = lambda n: _column(names, n)
        parts.append(lines.where(~F.col("value").startswith("#")).select(
            F.lit(code).alias("assay"), c("chrom").alias("chrom"), c("start").try_cast("long").alias("start"), c("end").try_cast("long").alias("end"), c("name").alias("name"),
            c("strand").alias("sign"), c("mod_score").try_cast("double").alias("percent"), c("type").alias("type"), c("cov").try_cast("long").alias("coverage"),
        ))
    rows = _union(parts)
    code = F.when(F.col("assay") == "5mC", "m").otherwise("h")
    ok = (
        (F.col("chrom") != "") & (F.col("start") >= 0) & (F.col("end") == F.col("start") + 1) & (F.col("name") == code) & F.col("type").isin(*METHBAT_TYPES)
        & is_finite(F.col("percent")) & F.col("percent").between(0, 100) & F.col("coverage").between(1, 65534)
        & F.when(F.col("assay") == "5mC", F.col("sign") == ".").otherwise(F.col("sign").isin("+", "-"))
    )
    bad = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("bad")).first()
    if bad["bad"] or not bad["n"]:
        raise ValueError(f"{bad['bad']} of {bad['n']} rows are invalid")
    named = rows.select(
        "assay", F.element_at(F.create_map(*[F.lit(v) for kv in METHBAT_TYPES.items() for v in kv]), F.col("type")).alias("haplotype"),
        F.element_at(F.create_map(*[F.lit(v) for kv in METHBAT_STRANDS.items() for v in kv]), F.col("sign")).alias("strand"), "chrom",
        shift_minus(F.col("start"), F.col("sign"), clamp=False).alias("pos0"), encode_percent(F.col("percent")).alias("value"), F.col("coverage").cast("int").alias("coverage"),
    )
    placed = named.join(index.select("chrom", "pos0", "row_id"), ["chrom", "pos0"], "left")
    receipt = import_receipt(placed, min_coverage)
    deep, on = F.col("coverage") >= min_coverage, F.col("row_id").isNotNull()
    obs = placed.where(deep & on).select(*OBS)
    twice = obs.groupBy("assay", "haplotype", "strand", "row_id").count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError("a position occurs twice in one track")
    if receipt.agg(F.sum("n_imported")).first()[0] in (None, 0):
        raise ValueError("no row lies on the index")
    return obs, receipt


def import_receipt(placed: DataFrame, min_coverage: int) -> DataFrame:
    """Rows per track: read, below the coverage, off the index, imported. ``row_id`` is null off the index; a
    null coverage is below any."""
    deep, on = F.coalesce(F.col("coverage") >= min_coverage, F.lit(False)), F.col("row_id").isNotNull()
    return placed.groupBy("assay", "haplotype", "strand").agg(
        F.count(F.lit(1)).alias("n_input"), F.count_if(~deep).alias("n_below"), F.count_if(deep & ~on).alias("n_off_index"), F.count_if(deep & on).alias("n_imported")
    )


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, start, end`` of a BED file; a header begins with ``#`` or ``chrom``; empty and reversed
    intervals are left out."""
    f = _fields(spark, path).where(~F.col("value").startswith("#") & ~F.lower("value").startswith("chrom\t"))
    r = f.select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).try_cast("long").alias("start"), F.get("f", F.lit(2)).try_cast("long").alias("end"))
    return r.where("end > start")


def read_segments(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Segment tables with a header, by sample id; empty intervals are left out."""
    parts = []
    for sample, path in files.items():
        t = spark.read.csv(path, sep="\t", header=True)
        t = t.withColumnRenamed("#chrom", "chrom")
        have = set(t.columns)
        parts.append(t.select(
            F.lit(sample).alias("sample_id"), "chrom", F.col("chrom_start").try_cast("long").alias("start"), F.col("chrom_end").try_cast("long").alias("end"), "name",
            *[(F.col(c).try_cast("double") if c in have else F.lit(None).cast("double")).alias(c) for c in ("effect_size", "cohen_h", "score")],
        ).where("end > start"))
    return _union(parts)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata table with a header, tabs or commas by its first line; ``id`` becomes ``sample_id``."""
    with open(path) as f:
        sep = "\t" if "\t" in f.readline() else ","
    t = spark.read.csv(path, sep=sep, header=True)
    if "sample_id" in t.columns:
        return t.drop("id")
    return t.withColumnRenamed("id", "sample_id") if "id" in t.columns else t
