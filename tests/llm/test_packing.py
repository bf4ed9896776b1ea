import random
from bisect import bisect_left, insort

import pytest

from cpgloom.llm.packing import container_fill, pack, plan_best_fit

PROFILES = "profile_id int, capacity_tokens int"


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_sound_and_tight(seed):
    r = random.Random(seed)
    cap = r.choice([7, 64, 512])
    hist = [(s, r.choice([1, 2, 3, 1000])) for s in r.sample(range(1, cap + 1), min(cap, 30))]
    rows, used = plan_best_fit(hist, cap)
    load, ranks = {}, {}
    for size, a, b, each, first in rows:
        for k in range(a, b + 1):
            c = first + (k - a) // each
            load[c] = load.get(c, 0) + size
            ranks.setdefault(size, []).append(k)
    assert max(load.values()) <= cap and set(load) == set(range(used))
    assert {s: sorted(k) for s, k in ranks.items()} == {s: list(range(n)) for s, n in hist}
    free = []  # item by item: the fullest container that takes it
    for size in sorted((s for s, n in hist for _ in range(n)), reverse=True):
        at = bisect_left(free, size)
        left = (free.pop(at) if at < len(free) else cap) - size
        insort(free, left)
    assert used == len(free)
    assert plan_best_fit([], cap) == ([], 0)


def check(rows, sizes, caps):
    load, pieces = {}, {}
    for r in rows:
        load[r["profile_id"], r["container_id"]] = load.get((r["profile_id"], r["container_id"]), 0) + r["n_tokens"]
        pieces.setdefault((r["profile_id"], r["doc_id"]), []).append((r["start_token"], r["n_tokens"]))
    for (p, _), v in load.items():
        assert v <= caps[p]
    assert len(pieces) == len(sizes) * len(caps)
    for (p, k), ps in pieces.items():
        n, at = sizes[k] or 0, 0
        for start, size in sorted(ps):
            assert start == at
            at += size
        assert at == n and len(ps) == max(1, -(-n // caps[p]))  # split only beyond the capacity
    return {p: len([1 for q, c in load if q == p and load[q, c]]) for p in caps}


def test_packs_everything(spark):
    r = random.Random(1)
    sizes = {i: r.choice([0, None, 5, 5, 5, r.randrange(1, 90), 250]) for i in range(900)}
    caps = {1: 50, 2: 100}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long")
    prof = spark.createDataFrame([*caps.items(), (3, None), (4, 0)], PROFILES)
    rows = pack(df, prof).collect()
    used = check(rows, sizes, caps)
    total = sum(v or 0 for v in sizes.values())
    assert all(used[p] <= -(-total // cap) + 1 for p, cap in caps.items())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, pack(df.repartition(7), prof, slices=64, rank_block=3).collect()))


def test_one_length_holds_most_items(spark):
    sizes = {i: 3 for i in range(5000)} | {9000 + i: 7 for i in range(10)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long")
    used = check(pack(df, spark.createDataFrame([(1, 10)], PROFILES)).collect(), sizes, {1: 10})
    assert used[1] == 10 + -(-4990 // 3)
    f = container_fill(pack(df, spark.createDataFrame([(1, 10)], PROFILES), slices=3, rank_block=50), spark.createDataFrame([(1, 10)], PROFILES)).first()
    assert (f["containers"], f["tokens"], f["least"]) == (used[1], 15070, 1507) and abs(f["fill"] - 15070 / (10 * used[1])) < 1e-12


def test_empty_tables_and_repeated_keys(spark):
    df = spark.createDataFrame([(1, 4), (1, 4), (None, 4)], "doc_id long, n_tokens long")
    prof = spark.createDataFrame([(1, 8)], PROFILES)
    assert sorted(r["container_id"] for r in pack(df, prof).collect()) == [0, 0, 1]
    assert pack(df.limit(0), prof).count() == 0 and pack(df, prof.limit(0)).count() == 0
    assert pack(df.selectExpr("doc_id", "0L AS n_tokens"), prof).select("container_id").distinct().count() == 1
