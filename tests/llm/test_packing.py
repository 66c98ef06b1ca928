import itertools
import random

from brookmill.llm.packing import pack, pack_items, pack_report


def loads(sizes, bins):
    out = {}
    for s, b in zip(sizes, bins):
        out.setdefault(b, []).append(s)
    return out


def fewest(sizes, capacity):
    best = len(sizes)

    def go(k, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if k == len(sizes):
            best = len(gaps)
            return
        for i in sorted(set(gaps), reverse=True):
            if i >= sizes[k]:
                rest = list(gaps)
                rest.remove(i)
                go(k + 1, [*rest, i - sizes[k]])
        go(k + 1, [*gaps, capacity - sizes[k]])

    go(0, [])
    return best


def test_near_the_optimum_on_small_cases():
    r = random.Random(0)
    over = 0
    for _ in range(120):
        sizes = sorted((r.randint(1, 50) for _ in range(r.randint(1, 9))), reverse=True)
        bins = pack(sizes, 50, 99)
        assert all(sum(x) <= 50 for x in loads(sizes, bins).values())
        over += len(set(bins)) - fewest(sizes, 50)
    assert over <= 6


def test_large_items_are_matched_optimally():
    r = random.Random(1)
    for _ in range(60):
        sizes = sorted((r.randint(34, 100) for _ in range(7)), reverse=True)
        most = 0
        for perm in itertools.permutations(range(7), 6):
            most = max(most, sum(sizes[a] + sizes[b] <= 100 for a, b in zip(perm[::2], perm[1::2])))
        assert len(set(pack(sizes, 100, 99))) == 7 - most


def test_limits_and_spread():
    r = random.Random(2)
    sizes = sorted([r.randint(300, 3000) for _ in range(300)] + [0, 1, 5] * 150, reverse=True)
    for most in (1, 2, 16, 10**9):
        held = loads(sizes, pack(sizes, 4096, most))
        assert all(sum(x) <= 4096 and len(x) <= most for x in held.values())
    held = loads(sizes, pack(sizes, 40000, 64))
    assert len(held) <= max(-(-sum(sizes) // 40000), -(-len(sizes) // 64)) + 1
    assert pack([], 10, 3) == [] and pack([0, 0, 0], 10, 2) == [0, 0, 1]


ITEMS = "id bigint, size int, budget string, container string"
BUDGETS = "budget string, capacity bigint, max_items int, item int"


def test_tables(spark):
    r = random.Random(3)
    sizes = {k: r.choice([r.randint(0, 300), r.randint(1000, 2500), 900]) for k in range(500)}
    rows = [(k, v, "x", "y") for k, v in sizes.items()] + [(1000, None, None, None), (1001, -5, "x", "y"), (7, sizes[7], "again", "y")]
    budgets = spark.createDataFrame([("small", 1000, 8, 1), ("free", 2500, None, 1), ("none", 0, 3, 1), ("zero", 10, 0, 1)], BUDGETS)
    items = spark.createDataFrame(rows, ITEMS)
    out = pack_items(items, budgets, "id", "size", group_items=100)
    got = out.collect()
    assert {x["budget"] for x in got} == {"small", "free"}
    for name, cap, most in (("small", 1000, 8), ("free", 2500, 10**9)):
        mine = [x for x in got if x["budget"] == name]
        bins = {}
        for x in mine:
            bins.setdefault(x["container"], []).append(x["tokens"])
        assert all(sum(b) <= cap and len(b) <= most for b in bins.values())
        total = {}
        for x in mine:
            total.setdefault(x["item"], []).append(x["tokens"])
        for k, v in sizes.items():
            n = 2 if k == 7 else 1
            assert sum(total[k]) == n * v and (len(total[k]) == n * max(1, -(-v // cap)))
        assert total[1000] == [0] and total[1001] == [0]
        assert sum(map(sum, bins.values())) / (len(bins) * cap) > 0.8
    assert pack_report(out, budgets).count() == 2
    assert pack_items(items.limit(0), budgets, "id", "size").count() == 0 and pack_items(items, budgets.limit(0), "id", "size").count() == 0
