"""Percentiles of very large numeric columns by distributed multi-select (problem 3).

All wanted ranks of a group are selected together. Proposers (hash slices of the values) each name
their local weighted medians, the weighted medians of those become pivots, values are counted below, at
and above each, and ranges that hold none of the wanted ranks are discarded. This repeats for every
group until each rank is found or its range is small enough for one task to sort. A pass does several
halvings at once: the median, those of the two halves, and so on.

A percentile p of n values is the value of rank ``ceil(p * n / 100)``: an observed value, with rank
error 0. The state of a batch or day is its table of value counts; states combine by adding counts, so
percentiles of any union of days come from their states and are as exact as from the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, keep

PERCENTS = (5, 25, 50, 75, 95, 99)
#: A group, or a range of one, with at most this many values is sorted by one task.
LOCAL_ROWS = 96
#: Hash slices of a group's values that propose medians.
PROPOSERS = 64
#: Halvings of a range that one pass does: medians, medians of the halves, and so on.
HALVINGS = 4
#: Tables of ranges up to this many rows are broadcast (about 200 bytes each); larger ones are joined on salted keys.
BROADCAST_ROWS = 50_000
RANK_ERROR = 0


def _common_type(df: DataFrame, values: dict[str, Column]) -> str:
    """The type that holds the values of all fields exactly: their own if it is one, 64-bit integers for
    integers, else double."""
    kinds = {f.dataType.simpleString() for f in df.select(*values.values()).schema}
    if kinds <= {"tinyint", "smallint", "int", "bigint"}:
        return "bigint"
    return kinds.pop() if len(kinds) == 1 else "double"


def _value(c: Column, kind: str) -> Column:
    """The value in its type; NaN is no value, and minus zero is zero."""
    c = c.cast(kind)
    return F.when(~F.isnan(c), c + F.lit(0).cast(kind)) if kind in ("double", "float") else c


def first_delivery(df: DataFrame, key: str, loaded: str) -> DataFrame:
    """Of rows with one ``key`` the one loaded first (a null time is last); rows with a null key stand
    for themselves. Ties on the time are broken by the other columns."""
    rest = [c for c in df.columns if c not in (key, loaded)]
    w = Window.partitionBy(key).orderBy(F.col(loaded).asc_nulls_last(), *[F.col(f"`{c}`") for c in rest])
    one = df.where(F.col(key).isNotNull()).withColumn("rn__", F.row_number().over(w)).where("rn__ <= 1").drop("rn__")
    return one.unionByName(df.where(F.col(key).isNull()))


def percentile_state(df: DataFrame, group: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """``<group>, field_name, value, n``: counts of the values of each field; null and NaN are none.
    Values keep their type (see ``_common_type``). Counts are added before the shuffle, and a group's
    values spread over all tasks."""
    kind = _common_type(df, values)
    cells = F.array(*[F.struct(F.lit(k).alias("field_name"), _value(c, kind).alias("value")) for k, c in values.items()])
    long = df.select(*group, F.inline(cells)).where(F.col("value").isNotNull())
    return long.groupBy(*group, "field_name", "value").agg(F.count(F.lit(1)).alias("n"))


def merge_states(states: Sequence[DataFrame], group: Sequence[str]) -> DataFrame:
    """The state of the union of disjoint batches; ``group`` may be coarser than theirs (for instance
    without the day)."""
    cols = [*group, "field_name", "value"]
    both = reduce(lambda a, b: a.unionByName(b), [s.select(*cols, "n") for s in states])
    return both.groupBy(*cols).agg(F.sum("n").alias("n"))


def _attach(items: DataFrame, table: DataFrame, on: list[str], small: bool, proposers: int) -> DataFrame:
    """Join the few ranges to the many items: broadcast below the bound, else on keys salted by slice."""
    if small:
        return items.join(F.broadcast(table), on)
    salted = table.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(proposers - 1))))
    return items.join(salted, [*on, "slice"])


def _finish(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Ranges of at most LOCAL_ROWS items: sort, and take the value where the running count reaches the
    rank. Gives ``g, p, value``."""
    w = Window.partitionBy("g", "r").orderBy("value")
    run = items.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ks = targets.select("g", "r", F.inline("ks"))
    hit = (F.col("k") <= F.col("upto")) & (F.col("k") > F.col("upto") - F.col("n"))
    return run.join(ks, ["g", "r"]).where(hit).select("g", "p", "value")


def _pivots(items: DataFrame, parts: int) -> DataFrame:
    """``g, r, pv``: pivots that cut every range into about ``parts`` equal parts.

    Every slice proposes its weighted median, the medians of its halves and so on (its j/parts points);
    the weighted median of the slices' proposals for one j is a pivot."""
    w = Window.partitionBy("g", "r", "slice")
    local = items.withColumns({
        "c": F.sum("n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), "t": F.sum("n").over(w)
    })
    first, last = F.expr(f"(c - n) * {parts} div t + 1"), F.least(F.expr(f"c * {parts} div t"), F.lit(parts - 1).cast("long"))
    proposed = local.where(first <= last).select("g", "r", F.explode(F.sequence(first, last)).alias("j"), F.col("value").alias("pivot"), F.col("t").alias("weight"), "slice")
    w = Window.partitionBy("g", "r", "j")
    agreed = proposed.withColumns({
        "c": F.sum("weight").over(w.orderBy("pivot", "slice").rowsBetween(Window.unboundedPreceding, 0)), "t": F.sum("weight").over(w)
    })
    agreed = agreed.where((2 * F.col("c") >= F.col("t")) & (2 * (F.col("c") - F.col("weight")) < F.col("t")))
    return agreed.groupBy("g", "r").agg(F.array_sort(F.collect_set("pivot")).alias("pv"))


def multi_select(
    state: DataFrame,
    group: Sequence[str],
    percents: Sequence[int] = PERCENTS,
    *,
    local_rows: int = LOCAL_ROWS,
    proposers: int = PROPOSERS,
    halvings: int = HALVINGS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Percentiles of a state (``<group>, value, n``): ``<group>, n, p<percent>...``.

    Null group values form a group of their own. Rows with a null value or a count below 1 take no
    part; an empty state gives no rows. The number of passes grows with the logarithm of the largest
    group; values are written once a pass to the shared folder, and only numbers of ranges reach the
    driver.
    """
    state = state.where(F.col("value").isNotNull() & (F.col("n") > 0))
    key = F.struct(*[F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(group)])
    kept = keep(state.select(key.alias("key"), F.col("value"), F.col("n").cast("long").alias("n")))
    # groups are numbered, so that only their number travels with each value
    totals = kept.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("m"))
    totals = cut_lineage(totals.withColumn("g", F.monotonically_increasing_id()))
    n_groups = totals.count()
    ks = F.array(*[F.struct(F.lit(p).alias("p"), F.expr(f"(total * {p} + 99) div 100").alias("k")) for p in percents])
    names = totals.select("key", "g")
    items = kept.join(F.broadcast(names) if n_groups <= broadcast_rows else names, "key").select(
        "g", F.lit(min(percents)).alias("r"), "value", "n", F.pmod(F.xxhash64("g", "value"), F.lit(proposers)).cast("int").alias("slice")
    )
    found: list[DataFrame] = []
    ranges = totals.select("g", F.lit(min(percents)).alias("r"), "m", ks.alias("ks"))
    while True:
        stats = ranges.agg(
            F.count_if(F.col("m") <= local_rows).alias("ready"), F.count_if(F.col("m") > local_rows).alias("open")
        ).first()
        if stats["ready"]:
            done = ranges.where(F.col("m") <= local_rows).select("g", "r", "ks")
            part = _attach(items, done.select("g", "r"), ["g", "r"], stats["ready"] <= broadcast_rows, proposers) if stats["open"] else items
            found.append(_finish(part.select("g", "r", "value", "n"), done))
        if not stats["open"]:
            break
        small = stats["open"] <= broadcast_rows
        active = ranges.where(F.col("m") > local_rows).select("g", "r", "ks")
        items = _attach(items, active.select("g", "r"), ["g", "r"], small, proposers).select("g", "r", "value", "n", "slice")
        pivots = cut_lineage(_pivots(items, 1 << halvings))
        # count three ways at every pivot: odd places are equal to one, even ones lie between two
        place = 2 * F.size(F.filter("pv", lambda x: x < F.col("value"))) + F.array_contains("pv", F.col("value")).cast("int")
        placed = keep(_attach(items, pivots, ["g", "r"], small, proposers).select("g", "r", "value", "n", "slice", place.alias("b")))
        counts = placed.groupBy("g", "r", "b").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("m"), F.min("value").alias("value"))
        below = F.coalesce(F.sum("w").over(Window.partitionBy("g", "r").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hits = counts.withColumn("below", below).join(active.select("g", "r", F.inline("ks")), ["g", "r"])
        hits = cut_lineage(hits.where((F.col("k") > F.col("below")) & (F.col("k") <= F.col("below") + F.col("w"))))
        found.append(hits.where("b % 2 = 1").select("g", "p", "value"))
        # keep the parts that hold wanted ranks, discard the others
        sides = hits.where("b % 2 = 0").groupBy("g", F.col("r").alias("old"), "b").agg(
            F.min("p").alias("r"), F.max("m").alias("m"), F.sort_array(F.collect_list(F.struct("p", (F.col("k") - F.col("below")).alias("k")))).alias("ks")
        )
        sides = cut_lineage(sides)
        few = sides.select("g", "old", "b", "r")
        items = _attach(placed.withColumnRenamed("r", "old"), few, ["g", "old", "b"], few.count() <= broadcast_rows, proposers).select("g", "r", "value", "n", "slice")
        ranges = sides.select("g", "r", "m", "ks")
    every = reduce(lambda a, b: a.unionByName(b), found) if found else items.select("g", F.col("r").alias("p"), "value")
    wide = every.groupBy("g").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{p:02d}") for p in percents])
    return totals.join(wide, "g").select(
        *[F.col(f"key.g{i}").alias(c) for i, c in enumerate(group)],
        F.col("total").alias("n"),
        *[f"p{p:02d}" for p in percents],
    )


def group_percentiles(
    df: DataFrame,
    group: Sequence[str],
    values: dict[str, Column],
    percents: Sequence[int] = PERCENTS,
    *,
    upper_count: DataFrame | None = None,
    local_rows: int = LOCAL_ROWS,
    proposers: int = PROPOSERS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Percentiles of the fields ``values`` of every group of rows: ``<group>, field_name, n,
    p<percent>..., rank_error``. A group without a value of a field has n = 0 and null percentiles.
    Values keep their type: integers come out as 64-bit integers, fractions as they are; fields of
    different types as double. NaN counts as no value. Null group values form a group. Repeated rows count as often as they occur; columns of ``df``
    that are neither group nor value are ignored. An empty table gives no rows.

    ``upper_count``: rows from which group sizes may be counted cheaply, at least as many per group as
    in ``df`` (default ``df``). Groups of at most ``local_rows`` rows are the base case of the rounds and
    gathered by one task each; the others go through the state and multi-select, and never meet in one
    task.
    """
    names = [f"k{i}" for i in range(len(group))]
    cells = {f"v{i}": c for i, c in enumerate(values.values())}
    fields = list(values)
    kind = _common_type(df, values)
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(group, names)], *[_value(c, kind).alias(v) for v, c in cells.items()])
    sized = (df if upper_count is None else upper_count).select(*[F.col(f"`{c}`").alias(k) for c, k in zip(group, names)])
    hot = sized.groupBy(*names).count().where(F.col("count") > local_rows).drop("count")
    hot = cut_lineage(hot)
    n_hot = hot.count()
    small_rows, out = rows, []
    if n_hot:
        few = F.broadcast(hot) if n_hot <= broadcast_rows else hot
        rows = small_rows = keep(rows)  # the rows are made once for both ways
        safe = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(hot[k]) for k in names])
        small_rows = rows.join(few, safe, "left_anti")
        big_rows = rows.join(few, safe, "left_semi")
        state = percentile_state(big_rows, names, {f: F.col(v) for f, v in zip(fields, cells)})
        chosen = multi_select(
            state, [*names, "field_name"], percents, local_rows=local_rows, proposers=proposers, broadcast_rows=broadcast_rows
        )
        every = hot.select(*names, F.explode(F.array(*[F.lit(f) for f in fields])).alias("field_name"))
        same = reduce(lambda a, b: a & b, [every[k].eqNullSafe(chosen[k]) for k in [*names, "field_name"]])
        joined = every.join(chosen, same, "left")
        out.append(
            joined.select(
                *[every[k] for k in [*names, "field_name"]],
                F.coalesce(chosen["n"], F.lit(0)).alias("n"),
                *[chosen[f"p{p:02d}"] for p in percents],
            )
        )
    lists = small_rows.groupBy(*names).agg(*[F.array_sort(F.collect_list(v)).alias(v) for v in cells])
    per_field = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(v).alias("vs")) for f, v in zip(fields, cells)])
    n = F.size("vs").cast("long")
    local = lists.select(*names, F.inline(per_field)).select(
        *names,
        "field_name",
        n.alias("n"),
        *[F.get("vs", F.expr(f"(size(vs) * {p} + 99) div 100 - 1").cast("int")).alias(f"p{p:02d}") for p in percents],
    )
    both = reduce(lambda a, b: a.unionByName(b), [local, *out])
    return both.select(
        *[F.col(k).alias(c) for k, c in zip(names, group)],
        "field_name",
        "n",
        *[f"p{p:02d}" for p in percents],
        F.lit(RANK_ERROR).alias("rank_error"),
    )


TRACK = ["assay", "haplotype", "strand"]


def _day() -> Column:
    return F.col("loaded_at").cast("date")


def _usable() -> dict[str, Column]:
    return {
        "value_u16": F.when(F.col("value_u16").between(0, 10000), F.col("value_u16")),
        "coverage": F.when(F.col("coverage").between(1, 65534), F.col("coverage")),
    }


def _once(track: DataFrame) -> DataFrame:
    cols = ["obs_id", *TRACK, "sample_id", "value_u16", "coverage", "loaded_at"]
    return first_delivery(track.select(*cols), "obs_id", "loaded_at").withColumn("day", _day())


def track_percentiles(track: DataFrame) -> DataFrame:
    """Problem 3: percentiles of usable value_u16 and coverage per track, sample and day of loaded_at.
    An obs_id counts once, on the day of its first delivery."""
    group = [*TRACK, "sample_id", "day"]
    return group_percentiles(
        _once(track), group, _usable(), upper_count=track.select(*TRACK, "sample_id", _day().alias("day"))
    )


def track_states(track: DataFrame) -> DataFrame:
    """The state of every track, sample and day, to be kept and combined."""
    return percentile_state(_once(track), [*TRACK, "sample_id", "day"], _usable())


#: The same for combined states: their groups are few, so that larger ranges per task save passes.
COMBINED_LOCAL_ROWS = 8192


def combined_percentiles(states: Sequence[DataFrame], group: Sequence[str] = TRACK, local_rows: int = COMBINED_LOCAL_ROWS) -> DataFrame:
    """Percentiles of the union of stored daily states, by default per track over all samples."""
    out = multi_select(merge_states(states, group), [*group, "field_name"], local_rows=local_rows)
    return out.withColumn("rank_error", F.lit(RANK_ERROR))
