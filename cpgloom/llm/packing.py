"""Packing texts into containers of fixed capacity (problem 7).

The plan is made from the histogram of lengths, not from the documents: best-fit decreasing places
all items of one length at once into groups of equally filled containers. Every item then takes its
planned slot by its rank within its length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import DEFAULT_TOKENIZER, encode_corpus

#: Items of one length are ranked in independent slices: this many at least, and one per SLICE_ITEMS items.
SLICES, SLICE_ITEMS = 64, 1_000_000
#: Slots are looked up by length and block of ranks, so that no length, however frequent, is one key.
RANK_BLOCK = 4096
#: A plan of up to this many rows (some 50 bytes each) is broadcast.
BROADCAST_ROWS = 200_000


def plan_best_fit(histogram: Sequence[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over ``(size, count)`` with 0 < size <= capacity.

    Returns ``(size, first_rank, last_rank, per_container, first_container)`` rows, where ranks from 0
    fill ``per_container`` items into each of consecutive containers, and the number of containers.
    Open containers are kept as runs of equal free space; a size splits a run at most twice, so the
    plan grows with the number of distinct sizes, not with the counts.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # free space -> [(first container, containers)]
    free: list[int] = []
    used = 0

    def put(space: int, first: int, n: int) -> None:
        if space > 0 and n > 0:
            if space not in runs:
                runs[space] = []
                insort(free, space)
            runs[space].append((first, n))

    for size, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            at = bisect_left(free, size)
            if at == len(free):
                first, n, space = used, -(-(count - rank) // (capacity // size)), capacity
                used += n
            else:
                space = free[at]
                first, n = runs[space].pop()
                if not runs[space]:
                    del runs[space], free[at]
            each = space // size
            full = min(n, (count - rank) // each)
            if full:
                rows.append((size, rank, rank + full * each - 1, each, first))
                rank += full * each
                put(space - each * size, first, full)
            left = count - rank if full < n else 0
            if left:  # fewer than one container takes
                rows.append((size, rank, count - 1, left, first + full))
                rank = count
                put(space - left * size, first + full, 1)
                full += 1
            put(space, first + full, n - full)
    return rows, used


def _schema(sizes: DataFrame, key: str) -> str:
    kind = sizes.schema[key].dataType.simpleString()
    return f"profile_id int, container_id long, `{key}` {kind}, piece long, start_token long, n_tokens long"


def pack(
    sizes: DataFrame, profiles: DataFrame, key: str = "doc_id", size: str = "n_tokens", slices: int = SLICES, rank_block: int = RANK_BLOCK
) -> DataFrame:
    """Assign every item of ``sizes`` to a container of every profile.

    Returns ``profile_id, container_id, <key>, piece, start_token, n_tokens``; containers are numbered
    from 0 within their profile. An item larger than the capacity is split into pieces of exactly the
    capacity and a rest; no other item is split. Items of size 0 or null take no space: they are spread
    over the containers (container 0 if there is none). Profiles with a null capacity or one below 1
    hold nothing and give no rows. Keys may be null or repeated: each row is an item.

    Plan: only the histogram, at most one row per profile and size up to the capacity, reaches the
    driver. Ranks within a size are counted in independent slices with offsets (at least ``slices``, more
    for many items), so a size that holds a third of all items is ranked by many tasks. An item finds its
    slot among the plan rows that touch its block of ``rank_block`` ranks.
    """
    spark = sizes.sparkSession
    caps = profiles.where(F.col("capacity_tokens") >= 1).groupBy("profile_id").agg(F.max("capacity_tokens").cast("long").alias("cap"))
    caps = caps.where(F.col("profile_id").isNotNull())
    capacity = {r["profile_id"]: r["cap"] for r in caps.collect()}  # the table of profiles
    if not capacity:
        return spark.createDataFrame([], _schema(sizes, key))
    slices = max(slices, sizes.count() // SLICE_ITEMS)
    per_profile = [
        F.struct(F.lit(p).alias("profile_id"), F.lit(c).cast("long").alias("cap")) for p, c in sorted(capacity.items())
    ]
    items = (
        sizes.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("size"))
        .select("k", "size", F.inline(F.array(*per_profile)))
        .select(
            "profile_id",
            "cap",
            "k",
            "size",
            F.explode(F.expr("sequence(0L, greatest(size - 1, 0L) div cap)")).alias("piece"),
        )
        .select(
            "profile_id",
            "k",
            "piece",
            (F.col("piece") * F.col("cap")).alias("start_token"),
            F.least(F.col("cap"), F.col("size") - F.col("piece") * F.col("cap")).alias("n_tokens"),
            F.pmod(F.xxhash64("k", "piece"), F.lit(slices)).cast("int").alias("slice"),
        )
    )
    per_slice = cut_lineage(items.groupBy("profile_id", "n_tokens", "slice").agg(F.count(F.lit(1)).alias("n")))
    histogram: dict[int, list[tuple[int, int]]] = {p: [] for p in capacity}
    for r in per_slice.groupBy("profile_id", "n_tokens").agg(F.sum("n").alias("n")).collect():  # at most cap + 1 a profile
        if r["n_tokens"] > 0:
            histogram[r["profile_id"]].append((r["n_tokens"], r["n"]))
    rows, used = [], {}
    for p, cap in capacity.items():
        planned, used[p] = plan_best_fit(histogram[p], cap)
        rows += [(p, *row) for row in planned]
    plan = spark.createDataFrame(rows, "profile_id int, n_tokens long, r0 long, r1 long, each long, c0 long")
    plan = plan.withColumn("block", F.explode(F.expr(f"sequence(r0 div {rank_block}, r1 div {rank_block})")))
    n_slots = sum(r1 // rank_block - r0 // rank_block + 1 for _, _, r0, r1, _, _ in rows)
    if n_slots <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    n_used = spark.createDataFrame([(p, max(1, n)) for p, n in used.items()], "profile_id int, containers long")
    before = Window.partitionBy("profile_id", "n_tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    in_slice = Window.partitionBy("profile_id", "n_tokens", "slice").orderBy("k", "piece")
    ranked = (
        items.withColumn("rn", F.row_number().over(in_slice))
        .join(offsets, ["profile_id", "n_tokens", "slice"])
        .withColumn("rank", F.col("offset") + F.col("rn") - 1)
    )
    placed = ranked.where("n_tokens > 0").withColumn("block", F.expr(f"rank div {rank_block}")).join(plan, ["profile_id", "n_tokens", "block"])
    placed = placed.where(F.col("rank").between(F.col("r0"), F.col("r1"))).withColumn("container_id", F.col("c0") + F.expr("(rank - r0) div each"))
    empty = ranked.where("n_tokens = 0").join(F.broadcast(n_used), "profile_id").withColumn("container_id", F.expr("rank % containers"))  # one row per profile
    out = ["profile_id", "container_id", F.col("k").alias(key), "piece", "start_token", "n_tokens"]
    return placed.select(*out).unionByName(empty.select(*out))


def container_fill(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """``profile_id, capacity_tokens, containers, least, tokens, fill``: containers used, the fewest that the
    tokens could take, and the share of the used space that is filled."""
    used = packed.groupBy("profile_id").agg((F.max("container_id") + 1).alias("containers"), F.sum("n_tokens").alias("tokens"))
    caps = profiles.groupBy("profile_id").agg(F.max("capacity_tokens").cast("long").alias("capacity_tokens"))
    return used.join(caps, "profile_id").select(
        "profile_id", "capacity_tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), "tokens",
        (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"),
    )


def pack_documents(documents: DataFrame, profiles: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Problem 7: documents measured in tokens, packed for each capacity of ``pack_profile``."""
    sizes = cut_lineage(encode_corpus(documents, "doc_id", "text", tokenizer, counts_only=True))
    return pack(sizes, profiles)
