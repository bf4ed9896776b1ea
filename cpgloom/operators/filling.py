"""Filling missing cells from similar records (problem 4).

Each target has a list of group levels from fine to coarse. A cell without usable content takes the
median (numbers) or the mode (categories) of the finest level whose group holds enough usable cells;
a flag column names the level, so every filled cell is marked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FillTarget:
    """``column`` to fill; ``usable`` gives its usable content, else null; ``statistic`` is ``median``
    (lower median, an observed value) or ``mode`` (ties: smallest value); ``levels`` are the grouping
    columns from fine to coarse; ``support`` the usable cells a level needs (one number per level)."""

    column: str
    usable: Column
    statistic: str
    levels: Sequence[Sequence[str]]
    support: Sequence[int] = field(default=())

    def needs(self, i: int) -> int:
        return self.support[i] if i < len(self.support) else 1


def _statistics(src: DataFrame, keys: Sequence[str], cells: list[tuple[str, str]]) -> DataFrame:
    """Per group: usable count and statistic of each (cell column, statistic)."""
    aggs = []
    for u, stat in cells:
        aggs.append(F.count(u).alias(f"{u}n"))
        value = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {u})") if stat == "median" else F.mode(u, True)
        aggs.append(value.alias(f"{u}v"))
    return src.groupBy(*keys).agg(*aggs)


def fill_missing(df: DataFrame, targets: Sequence[FillTarget]) -> DataFrame:
    """All rows of ``df``; for every target also ``<column>_filled`` (usable content, else the fill,
    else null) and ``<column>_fill_level`` (null: not filled; else the level from 1, the finest).

    A null in a grouping column belongs to no group at that level. Rows that were delivered more than
    once count as often in the statistics, and each is filled. Clashing names: columns of ``df`` that
    are called like an output column are replaced. An empty table gives an empty table.

    Plan: rows without an unusable cell pass straight through and are never shuffled. The others, a
    small share, are joined to group statistics that were pre-aggregated before their shuffle, so a
    group of any size arrives as partial aggregates; targets with equal levels share one aggregation.
    """
    names = {c: f"c{i}" for i, c in enumerate(dict.fromkeys(c for t in targets for lv in t.levels for c in lv))}
    use = {t.column: f"u{i}_" for i, t in enumerate(targets)}
    slim = df.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()], *[t.usable.alias(use[t.column]) for t in targets]
    )
    own = {f"{t.column}_filled" for t in targets} | {f"{t.column}_fill_level" for t in targets}
    keep = [c for c in df.columns if c not in own]
    body = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
        *[t.usable.alias(use[t.column]) for t in targets],
    )
    unusable = reduce(lambda a, b: a | b, [F.col(u).isNull() for u in use.values()])
    by_levels: dict[tuple, list[FillTarget]] = {}
    for t in targets:
        for i, level in enumerate(t.levels):
            by_levels.setdefault(tuple(names[c] for c in level), []).append(t)
    todo = body.where(unusable)
    for j, (keys, ts) in enumerate(by_levels.items()):
        cells = [(use[t.column], t.statistic) for t in ts]
        src = slim.where(reduce(lambda a, b: a | b, [F.col(u).isNotNull() for u, _ in cells]))
        for key in keys:
            src = src.where(F.col(key).isNotNull())
        st = _statistics(src, keys, cells)
        st = st.select(*keys, *[F.col(f"{u}{p}").alias(f"{u}{p}{j}") for u, _ in cells for p in "nv"])
        todo = todo.join(st, list(keys), "left")
    order = list(by_levels)
    outs = []
    for t in targets:
        u = use[t.column]
        value, level = F.lit(None), F.lit(None).cast("int")
        for i in reversed(range(len(t.levels))):
            j = order.index(tuple(names[c] for c in t.levels[i]))
            enough = F.col(f"{u}n{j}") >= t.needs(i)
            value = F.when(enough, F.col(f"{u}v{j}")).otherwise(value)
            level = F.when(enough, F.lit(i + 1)).otherwise(level)
        outs.append(F.coalesce(F.col(u), value.cast(df.schema[t.column].dataType)).alias(f"{t.column}_filled"))
        outs.append(F.when(F.col(u).isNull(), level).alias(f"{t.column}_fill_level"))
    filled = todo.select("row.*", *outs)
    complete = body.where(~unusable).select(
        "row.*",
        *[
            c
            for t in targets
            for c in (
                F.col(use[t.column]).cast(df.schema[t.column].dataType).alias(f"{t.column}_filled"),
                F.lit(None).cast("int").alias(f"{t.column}_fill_level"),
            )
        ],
    )
    return complete.unionByName(filled)


def usable_value(c: Column) -> Column:
    return F.when(c.between(0, 10000), c)


def usable_coverage(c: Column) -> Column:
    return F.when(c.between(1, 65534), c)


def usable_platform(c: Column) -> Column:
    p = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(p.isin("ont", "pacbio", "methbat"), p)


def track_targets() -> list[FillTarget]:
    """Problem 4 over ``sample_track``: numbers from the same sample at the same place of the batch
    (a re-import), else from the other samples there; the platform from the same sample and assay of
    the batch, else from the same sample of the batch."""
    place = ["batch_id", "row_id", "assay", "haplotype", "strand"]
    numeric = [[*place, "sample_id"], place]
    return [
        FillTarget("value_u16", usable_value(F.col("value_u16")), "median", numeric),
        FillTarget("coverage", usable_coverage(F.col("coverage")), "median", numeric),
        FillTarget(
            "platform",
            usable_platform(F.col("platform")),
            "mode",
            [["batch_id", "sample_id", "assay"], ["batch_id", "sample_id"]],
            (3, 1),
        ),
    ]


def fill_tracks(track: DataFrame) -> DataFrame:
    return fill_missing(track, track_targets())


def filled_cells(track: DataFrame) -> DataFrame:
    """``obs_id, field_name`` of every cell that was filled; one row for a cell delivered twice."""
    out = fill_tracks(track)
    marks = F.array(*[F.when(F.col(f"{t.column}_fill_level").isNotNull(), F.lit(t.column)) for t in track_targets()])
    return (
        out.select("obs_id", F.explode(marks).alias("field_name"))
        .where(F.col("field_name").isNotNull())
        .distinct()
    )
