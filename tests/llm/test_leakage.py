import random

import numpy as np
import pytest

import brookmill.llm.leakage as M
from brookmill.llm.leakage import CHARACTERS, RADIUS, WORDS, Hashes, build_indexes, find_leaks, leaked, simhash

DOCS = "doc_id bigint, text string, item_id string, lang string"
ITEMS = "item_id bigint, text string, lang string, doc_id int"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n))


def cjk(seed, n):
    r = random.Random(seed)
    return "".join(chr(0x4E00 + r.randint(0, 3000)) for _ in range(n))


SHARED = prose(99, 40)
TEXTS = {1: prose(1, 80), 2: prose(2, 60), 3: SHARED + " " + prose(3, 50), 4: SHARED + " " + prose(4, 50)}
CJK = cjk(5, 90)


def cut(k, low, n):
    return " ".join(TEXTS[k].split()[low : low + n])


def cases():
    w = cut(1, 20, 30).split()
    swapped = [*w[:12], "REPLACED", *w[13:]]
    two = [*w[:12], "x", "y", *w[14:]]
    return {
        10: (TEXTS[1], {1}), 11: (f"{prose(50, 30)} {cut(1, 30, 25)} {prose(51, 30)}", {1}), 12: (f"{prose(50, 30)} {cut(1, 30, 24)} {prose(51, 30)}", set()),
        13: (prose(52, 20) + " " + " ".join(swapped) + " " + prose(53, 9), {1}), 14: (prose(52, 20) + " " + " ".join(two), set()),
        15: ("> **" + cut(2, 5, 30).upper().replace(" ", "*\n> ", 3) + "**", {2}), 16: ("<p>" + "­".join(cut(2, 5, 30)) + "</p>", {2}), 17: (cut(2, 0, 26).replace(" ", ", ") + "!", {2}),
        18: (SHARED, set()), 19: (SHARED + " " + cut(3, 40, 24), set()), 20: (SHARED + " " + cut(3, 40, 26), {3}), 21: (f"{cut(1, 0, 30)} {cut(2, 0, 30)}", {1, 2}),
        22: ("text " + CJK[10:50] + " text", {5}), 23: ("text " + CJK[10:49] + "。", set()), 24: ("，".join(CJK[k : k + 5] for k in range(0, 90, 5)), {5}), 25: (CJK[:30] + "龘" + CJK[31:60], {5}),
        26: (None, set()), 27: ("", set()), 28: ("   ", set()), 29: (prose(60, 60000) + " " + cut(1, 3, 30), {1}), 30: (prose(61, 200), set()),
    }


def test_leaks(spark):
    docs = spark.createDataFrame([(k, t, "clash", "xx") for k, (t, _) in cases().items()] + [(10, TEXTS[1], None, None)], DOCS)
    items = spark.createDataFrame([(k, t, "en", 0) for k, t in TEXTS.items()] + [(5, CJK, "zh", 0), (6, None, "en", 0), (7, "", None, 0), (8, "too short", "en", 0)], ITEMS)
    got = {}
    for r in find_leaks(docs, items).collect():
        got.setdefault(r["doc_id"], []).append(r["item_id"])
    for k, (_, want) in cases().items():
        assert set(got.get(k, [])) == want, k
    assert got[10] == [1, 1]  # a repeated row is found each time
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0


def test_items_as_a_table_give_the_same(spark):
    docs = spark.createDataFrame([(k, t, "clash", "xx") for k, (t, _) in cases().items()] + [(10, TEXTS[1], None, None), (None, TEXTS[2], None, None)], DOCS)
    items = spark.createDataFrame([(k, t, "en", 0) for k, t in TEXTS.items()] + [(5, CJK, "zh", 0), (6, None, "en", 0), (7, "", None, 0), (8, "too short", "en", 0)], ITEMS)
    rows = lambda df: sorted(((r["item_id"], r["doc_id"]) for r in df.collect()), key=str)
    assert rows(find_leaks(docs, items, broadcast_text=0)) == rows(find_leaks(docs, items)) and (2, None) in rows(find_leaks(docs, items, broadcast_text=0))
    assert find_leaks(docs.limit(0), items, broadcast_text=0).count() == 0


def test_the_index_is_small():
    texts = [(k, prose(k, 400), "en") for k in range(50)] + [(100 + k, cjk(k, 600), "zh") for k in range(20)] + [(200, " ".join("abcdefgh"[k % 8] for k in range(4000)), "en")]
    held = 0
    for i in build_indexes(texts):
        arrays = [x for x in vars(i).values() if isinstance(x, np.ndarray)] + [x for b in i.blocks for x in b]
        held += sum(x.nbytes for x in arrays if len(x) < 1 << 16)
    assert held < M.INDEX_BYTES * sum(len(t.encode()) for _, t, _ in texts)


@pytest.mark.parametrize("gap", range(2, 25))
@pytest.mark.parametrize("lang", ["en", "zh"])
def test_a_unit_replaced_after_every_few(gap, lang):
    spaced, split, fresh = (" ", str.split, prose) if lang == "en" else ("", list, cjk)
    item = split(fresh(300, 90))
    index = build_indexes([(1, spaced.join(item), lang)])
    for low in range(0, 30, 3):
        units = [x if (k + 1) % (gap + 1) else y for k, (x, y) in enumerate(zip(item[low : low + 60], split(fresh(301 + low, 400))))]
        text = spaced.join(split(fresh(500 + low, 20)) + units + split(fresh(600 + low, 20)))
        assert leaked([text], index, Hashes()) == [[1]]


def test_long_tags_do_not_count():
    words = cut(1, 0, 30).split()
    tag = '<a href="https://example.org/' + "x/y " * 200 + '">'
    assert leaked([" ".join([*words[:15], tag, *words[15:]])], build_indexes([(1, TEXTS[1], "en")]), Hashes()) == [[1]]


def test_all_fingerprints_within_the_radius_are_found():
    index = build_indexes([(1, prose(1, 400), "en")])[0]
    r = np.random.default_rng(0)
    probes = index.prints[r.integers(0, len(index.prints), 500)].copy()
    for k in range(500):
        for bit in r.choice(64, size=r.integers(0, 6), replace=False):
            probes[k] ^= np.uint64(1) << np.uint64(bit)
    want = {(i, j) for i, p in enumerate(probes) for j, q in enumerate(index.prints) if int(p ^ q).bit_count() <= RADIUS}
    assert set(zip(*(x.tolist() for x in index.near(probes)))) == want and len(want) > 250


def test_equal_windows_have_equal_prints():
    h = Hashes().of(prose(1, 30).split() * 2)
    p = simhash(h, np.arange(52), 8)
    assert (p[:22] == p[30:52]).all() and len(set(p[:30].tolist())) > 25


def test_every_passage_holds_a_whole_window():
    for u in (WORDS, CHARACTERS):
        assert u.window + u.stride - 1 <= u.passage // 2


def test_random_passages_against_brute_force():
    r = random.Random(7)
    index = build_indexes([(k, t, "en") for k, t in TEXTS.items()])
    for _ in range(150):
        k = r.choice([1, 2])
        n = r.randint(20, 32)
        low = r.randint(0, len(TEXTS[k].split()) - n)
        words = cut(k, low, n).split()
        if n > 4 and r.random() < 0.5:
            words[r.randint(2, n - 3)] = "zzz"
        text = prose(r.random(), r.randint(0, 17)) + " " + " ".join(words) + " " + prose(r.random(), r.randint(0, 17))
        assert leaked([text], index, Hashes()) == [[k] if n >= 25 else []]


def fewest_windows(length):
    """Fewest windows 11?11 in a passage of this length as passage() accepts it."""
    fewest = {("1", True): 0}
    for _ in range(length - 1):
        longer = {}
        for (tail, first), n in fewest.items():
            for c in "01":
                if c == "1" or tail.endswith("11") or first:
                    t = tail + c
                    hit = len(t) == 5 and t[:2] + t[3:] == "1111"
                    key = (t[-4:], first and c == "1")
                    longer[key] = min(longer.get(key, 99), n + hit)
        fewest = longer
    return min(n for (tail, first), n in fewest.items() if first or tail.endswith("11"))


def test_every_passage_holds_the_fewest_windows():
    for u in (WORDS, CHARACTERS):
        assert u.window == 5 and u.stride == 1
        assert min(fewest_windows(n) for n in range(u.passage, 3 * u.passage)) == u.fewest


@pytest.mark.parametrize(("lang", "size"), [("en", 25), ("zh", 40)])
def test_any_number_of_replaced_units_against_brute_force(lang, size):
    spaced, fresh = (" ", prose) if lang == "en" else ("", cjk)
    split = str.split if lang == "en" else list
    item = split(fresh(200, 120))
    index = build_indexes([(1, spaced.join(item), lang)])
    mine = index[lang == "zh"]
    r = random.Random(8)
    found = 0
    for case in range(300):
        low, n = r.randint(0, 120 - size - 3), size + r.randint(0, 3)
        units, other = item[low : low + n], split(fresh(r.random(), 400))
        places = range(1, n - 2, 3) if case % 10 == 0 else r.sample(range(2, n - 2), r.randint(2, 5))
        for p in places:
            units[p] = other[p]
        text = spaced.join(split(fresh(r.random(), r.randint(0, 17))) + units + split(fresh(r.random(), r.randint(0, 17))))
        h = Hashes().of(M.words(text) if lang == "en" else M.characters(text))
        want = any(mine.passage(h, 0, s) for s in range(-120, len(h)))
        assert leaked([text], index, Hashes()) == [[1] if want else []], (case, low, n, places)
        found += want
    assert 100 < found < 300


def test_replaced_words_off_the_grid_are_found(spark):
    words = cut(1, 21, 25).split()
    words[8], words[16] = "one", "other"
    docs = spark.createDataFrame([(k, " ".join([*prose(70, k).split(), *words, *prose(71, 9).split()]), None, None) for k in range(10)], DOCS)
    items = spark.createDataFrame([(1, TEXTS[1], "en", 0)], ITEMS)
    assert sorted(r["doc_id"] for r in find_leaks(docs, items).collect()) == list(range(10))
