"""Continuous periods and gaps of overlapping intervals (problem 1), and plain interval union.

Starts and ends of an entity are ranked independently of each other. With ``s(1..n)`` and ``e(1..n)``
the sorted starts and ends, a gap lies between ranks ``i`` and ``i + 1`` exactly when
``s(i + 1) > e(i)``: then the first ``i`` intervals have all ended before the next one begins. The end
ranks below a start are a running count, so no join of the two rankings is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Entities whose first column has at most this many rows are ranked by one task each.
HOT_ROWS = 200_000
#: Coordinates of the other entities are ranked within bins of this width, and bins within their entity.
#: It bounds the rows that one task sorts (distinct coordinates of a bin) whatever share an entity holds.
BIN_WIDTH = 1 << 20
#: A list of up to this many first-column values (some 50 bytes each) is broadcast.
BROADCAST_ROWS = 50_000


def _points(src: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Starts and ends counted per coordinate."""
    both = F.array(
        F.struct(F.col("a").alias("x"), F.lit(1).alias("s"), F.lit(0).alias("e")),
        F.struct(F.col("b").alias("x"), F.lit(0).alias("s"), F.lit(1).alias("e")),
    )
    return src.select(*keys, F.inline(both)).groupBy(*keys, "x").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))


def _boundaries(ranked: DataFrame) -> DataFrame:
    """Keep the coordinates where a period begins or ends, from the ranks ``s0`` and ``e0`` below each.

    A start begins a period where as many ends as starts lie below it: s(i + 1) > e(i). An end closes
    one where no start is left open and none begins at the same place."""
    head = (F.col("s") > 0) & (F.col("s0") == F.col("e0"))
    tail = (F.col("s") == 0) & (F.col("s0") == F.col("e0") + F.col("e"))
    return ranked.where(head | tail).withColumn("head", head)


def _spans(paired: DataFrame, entity: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Each boundary and the next one of its entity: a period after a head, a gap after a tail."""
    return paired.where(F.col("next").isNotNull()).select(
        F.when(F.col("head"), "period").otherwise("gap").alias("kind"),
        *[F.col(n).alias(c) for c, n in zip(entity, keys)],
        F.col("x").alias("span_start"),
        F.col("next").alias("span_end"),
    )


def _ranks(points: DataFrame, keys: Sequence[str]) -> tuple[Column, Column]:
    upto = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    return tuple(F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in "se")


def _whole(src: DataFrame, entity: Sequence[str], k: Sequence[str]) -> DataFrame:
    """One task ranks an entity: rows are dealt out once by entity and counted, ranked and paired there."""
    points = _points(src.repartition(*k), k)
    s0, e0 = _ranks(points, k)
    events = _boundaries(points.withColumns({"s0": s0, "e0": e0})).select(*k, "x", "head")
    return _spans(events.withColumn("next", F.lead("x").over(Window.partitionBy(*k).orderBy("x"))), entity, k)


def _binned(src: DataFrame, entity: Sequence[str], k: Sequence[str], bin_width: int) -> DataFrame:
    """Many tasks rank an entity: coordinates are counted before the shuffle, ranked within bins, and
    per-bin totals give the ranks at which a bin begins."""
    points = cut_lineage(_points(src, k).withColumn("bin", F.floor(F.col("x") / F.lit(bin_width))))
    at = [*k, "bin"]
    before = Window.partitionBy(*k).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = points.groupBy(*at).agg(F.sum("s").alias("s"), F.sum("e").alias("e")).select(
        *at, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_bin") for c in "se"]
    )
    s0, e0 = _ranks(points, at)
    ranked = points.join(totals, at).withColumns({"s0": F.col("s_bin") + s0, "e0": F.col("e_bin") + e0})
    events = cut_lineage(_boundaries(ranked).select(*at, "x", "head"))
    ahead = Window.partitionBy(*k).orderBy("bin")
    firsts = events.groupBy(*at).agg(F.min("x").alias("x")).select(*at, F.lead("x").over(ahead).alias("beyond"))
    follow = F.lead("x").over(Window.partitionBy(*at).orderBy("x"))
    return _spans(events.join(firsts, at).withColumn("next", F.coalesce(follow, "beyond")), entity, k)


def periods_and_gaps(
    df: DataFrame,
    entity: Sequence[str],
    start: str,
    end: str,
    *,
    size_key: Column | None = None,
    hot_rows: int = HOT_ROWS,
    bin_width: int = BIN_WIDTH,
) -> DataFrame:
    """Merge the intervals ``[start, end)`` of each entity and list the gaps.

    Returns ``kind, <entity columns>, span_start, span_end``: one ``period`` for each longest
    continuous span (touching intervals are continuous) and one ``gap`` for each uncovered span between
    two neighbouring periods. Rows with a null in an entity column or a coordinate, and empty or
    reversed intervals, take no part. Repeated rows change nothing. An empty table gives no rows.
    Other columns of ``df``, whatever their names, are ignored.

    ``size_key`` (default: the first entity column) is a cheap column that is constant within an entity;
    its row counts bound the entities' sizes. Entities of a value with more than ``hot_rows`` rows are
    ranked by bins of coordinates and never meet in one task. Both ways give the same rows.
    """
    k = [f"k{i}" for i in range(len(entity))]
    key = F.col(f"`{entity[0]}`") if size_key is None else size_key
    sized = df.select(key.alias("size_key"))
    src = df.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(entity, k)],
        F.col(f"`{start}`").cast("long").alias("a"),
        F.col(f"`{end}`").cast("long").alias("b"),
        key.alias("size_key"),
    ).where(F.col("b") > F.col("a"))
    for n in k:
        src = src.where(F.col(n).isNotNull())
    hot = sized.groupBy("size_key").count().where((F.col("count") > hot_rows) & F.col("size_key").isNotNull())
    hot = cut_lineage(hot.select("size_key"))
    n_hot = hot.count()
    if not n_hot:
        return _whole(src.drop("size_key"), entity, k)
    few = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
    cold = src.join(few, "size_key", "left_anti").drop("size_key")
    return _whole(cold, entity, k).unionByName(_binned(src.join(few, "size_key", "left_semi").drop("size_key"), entity, k, bin_width))


#: The blanks that uneven spelling may hold.
BLANKS = " \t\n\x0b\f\r"


def normal_chrom(c: Column) -> Column:
    """``chr1``..``chr22``, ``chrX``, ``chrY`` from uneven spellings; null if nothing is left."""
    low = F.lower(F.btrim(c, F.lit(BLANKS)))
    core = F.ltrim(F.when(low.startswith("chr"), F.substring(low, 4, 1 << 30)).otherwise(low), F.lit(BLANKS))
    core = F.when(F.length(core) <= 1, F.upper(core)).otherwise(core)
    return F.when(core != "", F.concat(F.lit("chr"), core))


def normal_name(c: Column) -> Column:
    """Lower case without surrounding blanks; null if blank."""
    n = F.lower(F.btrim(c, F.lit(BLANKS)))
    return F.when(n != "", n)


def segment_periods(segments: DataFrame) -> DataFrame:
    """Problem 1 over ``asm_segment``: entity (sample_id, chrom, name), coordinates chrom_start and
    chrom_end. A blank sample, chrom or name counts as absent."""
    clean = segments.select(
        F.when(F.trim("sample_id") != "", F.col("sample_id")).alias("sample_id"),
        normal_chrom(F.col("chrom")).alias("chrom"),
        normal_name(F.col("name")).alias("name"),
        "chrom_start",
        "chrom_end",
    )
    return periods_and_gaps(clean, ["sample_id", "chrom", "name"], "chrom_start", "chrom_end")
