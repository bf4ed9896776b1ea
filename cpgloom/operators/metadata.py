"""Metadata alignment, rosters and row-system alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import broad_tissue, canonical_root

#: Fixed: columns that may hold sample ids, best first; ids that may be shown instead; columns that group samples.
ID_COLUMNS = ("sample_name", "sample_id", "id", "sample", "sample_label")
SHORT_IDS = ("sample_id", "sample_id_y", "sample_name", "sample")
GROUP_COLUMNS = ("tissue_name", "tissue_broad", "analysis_group", "preservation", "center", "technology", "sex", "donor", "core")
MAX_CATEGORIES = 40


def align(samples: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of metadata on the candidate key that matches most samples, without regard to case and
    blanks; the first candidate wins a tie, and the first of several rows in order of the key column."""
    want = samples.select("sample_id", F.lower(F.trim("sample_id")).alias("key__"))
    hits = meta.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lower(F.trim(F.col(k).cast("string"))).alias("key__")) for i, k in enumerate(keys)
    ])).alias("x")).select("x.*").distinct().join(want.select("key__").distinct(), "key__").groupBy("i").count()
    best = hits.orderBy(F.col("count").desc(), "i").first()  # one row per candidate
    key = keys[best["i"]] if best else keys[0]
    m = meta.withColumn("key__", F.lower(F.trim(F.col(key).cast("string")))).where("key__ IS NOT NULL")
    m = m.withColumn("rn__", F.row_number().over(Window.partitionBy("key__").orderBy(key, *[c for c in meta.columns if c != key])))
    m = m.where("rn__ <= 1").drop("rn__", *(["sample_id"] if "sample_id" in meta.columns else []))
    return want.join(m, "key__", "left").drop("key__")


def append_roster(old: DataFrame, new: DataFrame) -> DataFrame:
    """Column order of a cohort after an append: per view the old samples in their order (here by name),
    then the new ones; a sample that is already there is not added."""
    view = ["assay", "haplotype", "strand"]
    both = old.withColumn("h", F.lit(0)).unionByName(new.withColumn("h", F.lit(1)))
    first = both.groupBy(*view, "sample_id").agg(F.min("h").alias("h"))
    ord_ = F.row_number().over(Window.partitionBy(*view).orderBy("h", "sample_id")).cast("long") - 1
    return first.select(*view, "sample_id", ord_.alias("col_ord"))


def align_rows(source: DataFrame, target: DataFrame) -> DataFrame:
    """Exact equi-join of intervals; ``matched`` is false where the target has no such row, so a caller
    can refuse a partial match."""
    t = target.select("chrom", "start", "end", "target_row")
    return source.join(t, ["chrom", "start", "end"], "left").select("group_row", "target_row", F.col("target_row").isNotNull().alias("matched"))


def remap(obs: DataFrame, alignment: DataFrame) -> DataFrame:
    """Observations of source rows placed on the target's rows; other target rows stay missing."""
    a = alignment.where("matched").select(F.col("group_row").alias("row_id"), "target_row")
    return obs.join(a, "row_id").drop("row_id").withColumnRenamed("target_row", "row_id")


def align_roots(samples: DataFrame, meta: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Left join of metadata to samples by the candidate column, and kind of match (the id itself, else its
    root), that most metadata rows fit; the first best one counts, a root match only if it fits more rows.
    Of several rows with one key the first by ``order`` counts. Without any fit all metadata is null."""
    want = samples.select("sample_id").distinct().select("sample_id", F.trim("sample_id").alias("exact"), canonical_root(F.col("sample_id")).alias("root"))
    forms = [(k, how) for k in keys for how in ("exact", "root")]
    value = lambda k, how: F.trim(F.col(f"`{k}`").cast("string")) if how == "exact" else canonical_root(F.col(f"`{k}`").cast("string"))
    long = meta.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(how).alias("how"), value(k, how).alias("key__")) for i, (k, how) in enumerate(forms)])).alias("x")).select("x.*")
    ids = want.select(F.explode(F.array(F.struct(F.lit("exact").alias("how"), F.col("exact").alias("key__")), F.struct(F.lit("root").alias("how"), F.col("root").alias("key__")))).alias("y")).select("y.*").distinct()
    hits = {r["i"]: r["count"] for r in long.where("key__ <> ''").join(ids, ["how", "key__"], "left_semi").groupBy("i").count().collect()}  # one row per candidate
    best = max(range(len(forms)), key=lambda i: (hits.get(i, 0), -i))
    k, how = forms[best]
    rest = [c for c in meta.columns if c not in ("sample_id", order)]
    if not hits.get(best):
        return want.select("sample_id", *[F.lit(None).cast(meta.schema[c].dataType).alias(c) for c in rest])
    m = meta.withColumn("key__", value(k, how)).where("key__ <> ''")
    m = m.withColumn("rn__", F.row_number().over(Window.partitionBy("key__").orderBy(order))).where("rn__ <= 1")
    return want.withColumn("key__", F.col(how)).join(m.select("key__", *rest), "key__", "left").select("sample_id", *rest)


def select_rows(meta: DataFrame, samples: DataFrame, key: str = "id", order: str | None = None) -> DataFrame | None:
    """The metadata rows of ``samples`` (``sample_id, col_ord``) in their order, or None unless every sample
    has exactly one. Without the key column, rows are taken by position (``order``) if their number fits."""
    n = samples.count()
    if key not in meta.columns:
        if order is None or meta.count() != n:
            return None
        return align_by_position(samples, meta, order).withColumnRenamed("sample_id", key)
    hit = meta.join(samples.select(F.col("sample_id").alias(key), "col_ord"), key)
    found = hit.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("ids")).first()
    return hit if found["rows"] == found["ids"] == n else None


def align_by_position(samples: DataFrame, meta: DataFrame, order: str) -> DataFrame:
    """Metadata without an id column beside ``sample_id, col_ord``, row by row; the numbers must be equal."""
    if samples.count() != meta.count():
        raise ValueError("metadata without ids needs as many rows as there are samples")
    at = lambda df, c: df.withColumn("at__", F.row_number().over(Window.orderBy(c)))  # noqa: E731  a table of samples
    return at(samples.select("sample_id", "col_ord"), "col_ord").join(at(meta, order), "at__").drop("at__")


def union_rosters(columns: DataFrame, order: str = "col_ord") -> DataFrame:
    """Samples of several views in the order in which they are first seen: by view, then column."""
    seen = columns.groupBy("sample_id").agg(F.min(F.struct("view_ord", order)).alias("at"))
    return seen.select("sample_id", F.row_number().over(Window.orderBy("at", "sample_id")).cast("long").alias("col_ord"))  # one row per sample


def shortest_unique_id(meta: DataFrame, key: str = "id") -> str:
    """The column to show as sample id: of those that are never blank, differ in every row and are not the
    key itself, the one with the shortest values; else the key. One aggregate over the table."""
    names = [c for c in dict.fromkeys((*SHORT_IDS, *[c for c in meta.columns if c.startswith("sample_id")])) if c in meta.columns and c != key]
    if not names:
        return key
    text = lambda c: F.trim(F.col(f"`{c}`").cast("string"))
    aggs = []
    for i, c in enumerate(names):
        aggs += [
            F.count_if(text(c).isNull() | (text(c) == "")).alias(f"blank{i}"), F.countDistinct(text(c)).alias(f"kinds{i}"),
            F.avg(F.length(text(c))).alias(f"size{i}"), F.count_if(text(c) != F.col(f"`{key}`").cast("string")).alias(f"other{i}"),
        ]
    r = meta.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    fit = [(r[f"size{i}"], i) for i in range(len(names)) if r["n"] and not r[f"blank{i}"] and r[f"kinds{i}"] == r["n"] and r[f"other{i}"]]
    return names[min(fit)[1]] if fit else key


def category_columns(meta: DataFrame, skip: tuple[str, ...] = ("sample_id", "sample_name", "display_id", "sample_root"), most: int = MAX_CATEGORIES) -> list[str]:
    """Columns with 2 to ``most`` different values that are not blank; usual ones first, then in table order."""
    names = [c for c in meta.columns if c not in skip]
    if not names:
        return []
    r = meta.agg(*[F.countDistinct(F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))).alias(f"k{i}") for i, c in enumerate(names)]).first()
    fit = [c for i, c in enumerate(names) if 2 <= r[f"k{i}"] <= most]
    return [c for c in GROUP_COLUMNS if c in fit] + [c for c in fit if c not in GROUP_COLUMNS]


def fill_broad_tissue(meta: DataFrame, name: str = "tissue_name", broad: str = "tissue_broad") -> DataFrame:
    """Broad tissue from the tissue's name where it is absent or blank; what is there stays."""
    if name not in meta.columns:
        return meta
    derived = broad_tissue(F.col(name))
    have = F.nullif(F.trim(F.col(broad)), F.lit("")) if broad in meta.columns else F.lit(None).cast("string")
    return meta.withColumn(broad, F.when(have.isNotNull(), F.col(broad)).otherwise(derived) if broad in meta.columns else derived)
