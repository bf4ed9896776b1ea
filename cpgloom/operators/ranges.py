"""Range joins without a nested loop: points in intervals, and overlaps of intervals.

An interval is placed on the level of a ladder of bin widths at which it spans at most two bins, and
also on those coarser levels at which the other side has intervals. Any two intervals that overlap meet
in a bin of the longer one's level, whatever their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_WIDTH = 1 << 10
LEVELS = 8
STEP = 3  # each level is 2**3 times as wide; the top one is 2**31 wide
#: A side of up to this many intervals (some 100 bytes each, before their columns) is broadcast.
BROADCAST_ROWS = 50_000


def _own_level(a: Column, b: Column) -> Column:
    n = F.greatest(b - a, F.lit(1))
    out = F.lit(LEVELS - 1)
    for lv in range(LEVELS - 2, -1, -1):
        out = F.when(n <= (BASE_WIDTH << (STEP * lv)), F.lit(lv)).otherwise(out)
    return out


def _bin(position: str) -> str:
    return f"({position}) div shiftleft({BASE_WIDTH}L, cast(lv * {STEP} as int))"


def _sized(df: DataFrame) -> tuple[list[int], int]:
    """Levels that a side's intervals live on (at most LEVELS numbers), and how many intervals there are."""
    got = df.groupBy("own").count().collect()
    return sorted(r["own"] for r in got), sum(r["count"] for r in got)


def _side(df: DataFrame, p: str) -> DataFrame:
    ok = df.where((F.col("end") > F.col("start")) & (F.col("start") >= 0) & F.col("chrom").isNotNull())
    return ok.select(
        *[F.col(f"`{c}`").alias(f"{p}{c}") for c in df.columns],
        F.col("chrom").alias("c"),
        F.col("start").cast("long").alias("a"),
        F.col("end").cast("long").alias("b"),
    ).withColumn("own", _own_level(F.col("a"), F.col("b")))


def _placed(df: DataFrame, other: list[int]) -> DataFrame:
    """Explode into (level, bin) rows: the own level and the coarser ones of the other side."""
    coarser = F.filter(F.array(*[F.lit(lv) for lv in other]).cast("array<int>"), lambda lv: lv > F.col("own"))
    out = df.withColumn("lv", F.explode(F.concat(F.array("own"), coarser)))
    return out.withColumn("bin", F.explode(F.expr(f"sequence({_bin('a')}, {_bin('greatest(b, a + 1) - 1')})")))


def overlap_join(left: DataFrame, right: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs of rows whose half-open intervals overlap. Both sides have ``chrom, start, end``; the result
    has their columns with ``l_`` and ``r_`` prefixes and ``overlap``, one row per pair. Null or empty
    intervals match nothing. Coordinates are not negative. A side of at most ``broadcast_rows`` intervals
    is broadcast (the right one is counted first); else both are shuffled by chromosome, level and bin."""
    one, two = _side(left, "l_"), _side(right, "r_")
    r_levels, n_right = _sized(two)
    if n_right <= broadcast_rows:  # the right side on every coarser level: at most 2 + LEVELS rows each
        x, y = _placed(one, r_levels), F.broadcast(_placed(two, list(range(LEVELS))))
    else:
        l_levels, n_left = _sized(one)
        x, y = _placed(one, r_levels), _placed(two, l_levels)
        x = F.broadcast(x) if n_left <= broadcast_rows else x
    x = x.select(*[c for c in x.columns if c.startswith("l_")], "c", "lv", "bin", "a", "b", "own")
    y = y.select(*[c for c in y.columns if c.startswith("r_")], "c", "lv", "bin", F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("own").alias("own2"))
    met = x.join(y, ["c", "lv", "bin"]).where(
        (F.col("a") < F.col("b2")) & (F.col("b") > F.col("a2")) & (F.greatest("own", "own2") == F.col("lv")) & (F.col("bin") == F.expr(_bin("greatest(a, a2)")))
    )
    return met.select(*[c for c in met.columns if c[:2] in ("l_", "r_")], (F.least("b", "b2") - F.greatest("a", "a2")).alias("overlap"))


def points_in_intervals(points: DataFrame, intervals: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every (point, interval) pair with ``start <= pos0 < end``: multiplicity is kept. Points have
    ``chrom, pos0``; result columns carry ``p_`` and ``i_`` prefixes. Points are copied only to the levels
    that the intervals live on. Few intervals (``broadcast_rows``) are broadcast, the points never."""
    spans = _side(intervals, "i_")
    levels, n = _sized(spans)
    x = _placed(spans, []).select(*[f"i_{c}" for c in intervals.columns], "c", "lv", "bin", "a", "b")
    at = points.where(F.col("pos0").isNotNull() & F.col("chrom").isNotNull())
    y = at.select(
        *[F.col(f"`{c}`").alias(f"p_{c}") for c in points.columns], F.col("chrom").alias("c"), F.col("pos0").cast("long").alias("pos"),
        F.explode(F.array(*[F.lit(lv) for lv in levels]).cast("array<int>")).alias("lv"),
    ).withColumn("bin", F.expr(_bin("pos")))
    met = y.join(F.broadcast(x) if n <= broadcast_rows else x, ["c", "lv", "bin"]).where((F.col("a") <= F.col("pos")) & (F.col("pos") < F.col("b")))
    return met.select(*[f"p_{c}" for c in points.columns], *[f"i_{c}" for c in intervals.columns])


def points_covered(points: DataFrame, intervals: DataFrame, key: str = "row_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The points in any interval, each once."""
    hit = points_in_intervals(points.select(key, "chrom", "pos0"), intervals.select("chrom", "start", "end"), broadcast_rows)
    return points.join(hit.select(F.col(f"p_{key}").alias(key)).distinct(), key, "left_semi")
