"""Filling containers of fixed capacity: large items are matched in pairs, small ones best-fit what is left."""

from __future__ import annotations

from bisect import bisect_left, insort
from heapq import heapify, heapreplace, heappop

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one packing group: enough that each group's last containers cost nothing, few enough for any executor.
GROUP_ITEMS = 20_000


def match_large(sizes: list[int], capacity: int, most: int) -> tuple[list[int], list[int], list[int]]:
    """(container of each item or -1, space left, items held) once the large items have their containers.

    Items over a third of the capacity can't be three to a container. The largest one left is matched with the largest
    other one that still fits beside it, which a greedy run over the two ends of the sorted list finds.
    """
    bins = [-1] * len(sizes)
    gap: list[int] = []
    held: list[int] = []
    n_large = sum(1 for s in sizes if 3 * s > capacity)
    free = sizes[:n_large]
    # greedy matching: for every item, from the largest, the largest unmatched partner that fits
    taken = [False] * n_large
    after = list(range(n_large + 1))  # next unmatched place, with path compression

    def find(k: int) -> int:
        root = k
        while after[root] != root:
            root = after[root]
        while after[k] != root:
            after[k], k = root, after[k]
        return root

    rising = [-s for s in free]
    for i in range(n_large):
        if taken[i]:
            continue
        taken[i] = True
        after[i] = i + 1
        b = len(gap)
        bins[i] = b
        gap.append(capacity - free[i])
        held.append(1)
        if most > 1:
            j = find(bisect_left(rising, -gap[b]))
            if j < n_large:
                taken[j] = True
                after[j] = j + 1
                bins[j] = b
                gap[b] -= free[j]
                held[b] = 2
    return bins, gap, held


def fill_best(sizes: list[int], capacity: int, most: int, bins: list[int], gap: list[int], held: list[int]) -> list[int]:
    """Puts the small items, largest first, where the least space takes them, or into a new container."""
    bins, held = list(bins), list(held)
    n_large = sum(1 for b in bins if b >= 0)
    places: dict[int, list[int]] = {}
    for b, g in enumerate(gap):
        if held[b] < most:
            places.setdefault(g, []).append(b)
    gaps = sorted(places)
    for i in range(n_large, len(sizes)):
        s = sizes[i]
        k = bisect_left(gaps, s)
        if k < len(gaps):
            g = gaps[k]
            b = places[g].pop()
            if not places[g]:
                del places[g], gaps[k]
        else:
            b, g = len(held), capacity
            held.append(0)
        bins[i] = b
        held[b] += 1
        if held[b] < most:
            left = g - s
            if left not in places:
                places[left] = []
                insort(gaps, left)
            places[left].append(b)
    return bins


def fill_even(sizes: list[int], most: int, bins: list[int], gap: list[int], held: list[int], n: int, capacity: int) -> list[int] | None:
    """Spreads the small items over ``n`` containers, each to the one with most space; None if some item finds no room."""
    bins, held = list(bins), list(held) + [0] * (n - len(held))
    heap = [(-g, b) for b, g in enumerate(gap + [capacity] * (n - len(gap))) if held[b] < most]
    heapify(heap)
    for i in range(sum(1 for b in bins if b >= 0), len(sizes)):
        if not heap or -heap[0][0] < sizes[i]:
            return None
        g, b = heap[0]
        bins[i] = b
        held[b] += 1
        if held[b] < most:
            heapreplace(heap, (g + sizes[i], b))
        else:
            heappop(heap)
    return bins


def pack(sizes: list[int], capacity: int, most: int) -> list[int]:
    """The container of each item, given in descending order of size, none over ``capacity``.

    Large items are matched first (match_large), the small ones best-fit the gaps (fill_best). Where that takes over a
    hundredth more containers than volume and ``most`` items a container demand, because small items fill up on places
    and not on space, they are spread evenly over fewer containers instead, if that succeeds with fewer.
    """
    bins, gap, held = match_large(sizes, capacity, most)
    best = fill_best(sizes, capacity, most, bins, gap, held)
    n_best = max(best, default=-1) + 1
    n = max(-(-sum(sizes) // capacity), -(-len(sizes) // most), len(gap), 1)
    tries = 0
    while n_best > n + n // 100 and tries < 12:
        even = fill_even(sizes, most, bins, gap, held, n, capacity)
        if even is not None:
            return even
        n, tries = n + max(1, n // 100), tries + 1
    return best


def pack_items(items: DataFrame, budgets: DataFrame, item: str, size: str, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(budget, container, item, piece, tokens): every item in containers of every budget's capacity.

    ``budgets``: budget, capacity, max_items (null: no limit). An item over the capacity is cut into full pieces and a
    rest; no other is split. Null and negative sizes count as 0; an item of size 0 takes a place, not space. Containers
    are packed independently within groups that a hash of the item spreads evenly, about ``group_items`` pieces each,
    so no group depends on the data's keys or grows with it; equal sizes go by item, so the result is reproducible. The
    price is at most a few part-filled containers a group. Budgets without a positive capacity or max_items get none.
    """
    kinds = budgets.where("capacity > 0 and coalesce(max_items, 1) > 0").select("budget", "capacity", F.coalesce("max_items", F.lit(2**31 - 1)).alias("max_items")).limit(1001).collect()
    if len(kinds) > 1000:
        raise ValueError("more than 1000 budgets")
    sized = items.select(F.col(item).alias("item"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    n = max(1, -(-items.count() // group_items))
    each = F.array(*(F.struct(F.lit(k["budget"]).alias("budget"), F.lit(k["capacity"]).cast("bigint").alias("capacity"), F.lit(k["max_items"]).cast("int").alias("max_items")) for k in kinds))
    if not kinds:
        each = F.lit(None).cast("array<struct<budget:string,capacity:bigint,max_items:int>>")
    pieces = sized.withColumn("_kind", F.explode(each)).select("item", "size", "_kind.*")
    pieces = pieces.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity"))).cast("int"))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1))).withColumn(
        "tokens", F.least(F.col("capacity"), F.col("size") - F.col("piece") * F.col("capacity")))
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("item", "piece"), F.lit(n)).cast("int")).select("budget", "capacity", "max_items", "group", "item", "piece", "tokens")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "item", "piece"], ascending=[False, True, True], kind="stable")
        bins = pack(pdf["tokens"].tolist(), int(pdf["capacity"].iloc[0]), int(pdf["max_items"].iloc[0]))
        return pdf.assign(container=[int(pdf["group"].iloc[0]) * 2**32 + b for b in bins])[["budget", "container", "item", "piece", "tokens"]]

    return pieces.groupBy("budget", "group").applyInPandas(fill, "budget string, container bigint, item bigint, piece int, tokens bigint")


def pack_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per budget containers, pieces, tokens, the share of space used, and the least number of containers by volume alone."""
    per = packed.groupBy("budget", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"))
    total = per.groupBy("budget").agg(F.count("*").alias("n_containers"), F.sum("k").alias("n_pieces"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.max("k").alias("most_pieces"))
    return total.join(budgets.select("budget", "capacity"), "budget").withColumn("used", F.col("tokens") / (F.col("n_containers") * F.col("capacity"))).withColumn(
        "least_containers", F.ceil(F.col("tokens") / F.col("capacity"))).drop("capacity")
