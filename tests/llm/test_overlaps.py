import math
import random

from pyspark.sql import functions as F

from brookmill.llm.overlaps import cosine_join, cross_split_pairs, overlap_report

SCHEMA = "row_no bigint, id string, video_path string, timeseries_path string, source string, split string, name string, vec int"


def test_cosine_join_against_brute_force(spark):
    r = random.Random(0)
    vectors = []
    for k in range(160):
        base = random.Random(k % 41)
        terms = {f"t{base.randint(0, 60):02d}": base.uniform(0.1, 3) for _ in range(base.randint(1, 12))}
        terms = {t: w * r.uniform(0.8, 1.2) for t, w in terms.items() if r.random() < 0.95}
        vectors.append((k, k % 2, sorted(terms.items())))
    df = spark.createDataFrame(vectors, "vec bigint, side int, terms array<struct<term:string,w:double>>")
    for t in (0.5, 0.8, 0.95):
        want = {}
        for a, s, x in vectors:
            for b, q, y in vectors:
                if s == 0 and q == 1 and x and y:
                    y_ = dict(y)
                    c = sum(w * y_.get(k, 0) for k, w in x) / math.sqrt(sum(w * w for _, w in x) * sum(w * w for _, w in y))
                    if c >= t:
                        want[a, b] = c
        got = {(p["a"], p["b"]): p["similarity"] for p in cosine_join(df, t).collect()}
        assert set(got) == set(want) and all(math.isclose(got[k], want[k]) for k in want) and want


def test_pairs_against_brute_force(spark):
    r = random.Random(1)
    rows, names = [], {}
    for k in range(600):
        e, ch, first = f"abcdefgh0{r.randint(0, 1)}", r.choice([None, None, 1]), r.randint(0, 40)
        last = first + r.choice([0, 1, 9, 100, 110, 120, 400])
        sep = r.choice("_-: ")
        text = f"{e}{sep}{first}{sep}{last}" + (f"{sep}ch{ch}" if ch is not None else "")
        source, split = r.choice("ab"), r.choice(["train", "train", "val", "test", None, "other"])
        by_path = r.random() < 0.3
        rows.append((k, None if by_path else text, f"x/{text}.mp4" if by_path and ch is None else None, f"x/{text}.csv", source, split, "n", 1))
        names[k] = (source, split, e, ch, first, last)
    rows += [(900, None, None, None, "a", "train", None, None), (901, "row-1", "", " ", None, "val", None, None), (902, "x" * 50000, None, None, "a", "test", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = set()
    for a, (s, t, e, c, f, q) in names.items():
        for b, (s2, t2, e2, c2, f2, q2) in names.items():
            if t == "train" and t2 in ("val", "test") and (s, e, c) == (s2, e2, c2):
                i, u = min(q, q2) - max(f, f2) + 1, max(q, q2) - min(f, f2) + 1
                if i > 0 and 10 * i >= 9 * u:
                    want.add((min(a, b), max(a, b)))
    pairs = cross_split_pairs(df)
    got = [(p["row_no_a"], p["row_no_b"]) for p in pairs.collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 50
    report = {(x["source"], x["split"]): x for x in overlap_report(df).collect() if x["source"]}
    assert sum(x["n_pairs"] for x in report.values()) == len(want)
    leaked = {b if names[b][1] != "train" else a for a, b in want}
    assert sum(x["n_leaked"] for x in report.values()) == len(leaked)


def test_one_name_very_often(spark):
    n = 100_000
    rows = spark.range(n + 30).select(
        F.col("id").alias("row_no"), F.when(F.col("id") < n, "abcdefgh01_0_99").otherwise(F.concat(F.lit("abcdefgh02_"), F.col("id").cast("string"), F.lit("_999999"))).alias("id"), F.lit(None).cast("string").alias("video_path"),
        F.lit("").alias("timeseries_path"), F.lit("a").alias("source"), F.when(F.col("id") % 25_000 == 7, "val").otherwise("train").alias("split"))
    pairs = cross_split_pairs(rows)
    want = 4 * (n - 4) + 29
    assert pairs.count() == want and pairs.select("row_no_a", "row_no_b").distinct().count() == want
    assert [tuple(r) for r in overlap_report(rows).collect()] == [("a", "val", 5, want, 5)]


def test_empty(spark):
    assert cross_split_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert cosine_join(spark.range(2).select(F.col("id").alias("vec"), F.lit(0).alias("side"), F.expr("cast(array() as array<struct<term:string,w:double>>)").alias("terms")), 0.9).count() == 0
