import os
import random

import pytest

from brookmill.llm.mixing import LEAST_QUALITY, VOCABULARY, allot, largest_total, mix_report, mix_sources, place_of, quality_of

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no public vocabulary here")
DOCS = "doc_id bigint, text string, source string, copies int, _weight double"
TARGETS = "source string, target_share double, max_repeats int, tokens string"


def test_allotment():
    goals = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("d", 0.0, 1), ("e", 0.1, 2)]
    have = {"a": 1000, "b": 100, "c": 1000}
    got = allot(have, goals, 900)
    assert got["b"] == 200 and got["d"] == got["e"] == 0 and abs(got["a"] - 500) < 1e-6 and abs(got["c"] - 200) < 1e-6
    assert sum(allot(have, goals, 1e9).values()) == 1000 + 200 + 3000 and sum(allot({}, goals, 100).values()) == 0
    assert abs(largest_total(have, goals) - 200 / 0.3) < 1e-6 and largest_total({}, goals) == 0


def corpus():
    r = random.Random(0)
    size = {"a": 400, "b": 40, "c": 200, "other": 50}
    rows, k = [], 0
    for s, n in size.items():
        for _ in range(n):
            rows.append((k, " ".join(r.choice(["river", "stone", "cloud", "the", "of"]) for _ in range(r.randint(1, 60))), s, 9, None))
            k += 1
    return rows + [(k, None, "a", 9, 1.0), (k + 1, "", "b", 9, 1.0), (k + 2, "no source", None, 9, 1.0), (k + 3, "tie", "a", 1, None), (k + 3, "tie", "a", 1, None)]


def test_shares_epochs_and_caps(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    targets = spark.createDataFrame([("a", 0.5, 1, ""), ("b", 0.3, 4, ""), ("c", 0.2, 2, ""), ("missing", 0.1, 3, ""), (None, 0.1, 1, ""), ("b2", None, None, "")], TARGETS)
    mixed = mix_sources(docs, targets)
    rows = mixed.collect()
    report = {r["source"]: r for r in mix_report(mixed, targets.where("source is not null").drop("tokens")).collect()}
    total = sum(r["tokens"] for r in report.values())
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(report[s]["tokens"] / total - w) < 0.01, s
    assert report["missing"]["tokens"] == 0 and {r["source"] for r in rows} == {"a", "b", "c"}
    copies = {r["doc_id"]: r["copies"] for r in rows if r["source"] == "b"}
    assert max(copies.values()) - min(copies.values()) <= 1 and max(copies.values()) <= 4 and len(copies) == 40
    assert {tuple(r) for r in mix_sources(docs, targets).collect()} == {tuple(r) for r in rows}
    big = mix_sources(docs, targets, total_tokens=10**7)
    assert {r["source"]: r["most_copies"] for r in mix_report(big, targets.where("source is not null").drop("tokens")).collect() if r["tokens"]} == {"a": 1, "b": 4, "c": 2}
    assert mix_sources(docs.limit(0), targets).count() == 0 and mix_sources(docs, targets.limit(0)).count() == 0


def test_weights_favour_records(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, "one two three", "a", 0, None) for k in range(2000)], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 1, "")], TARGETS)
    heavy = F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)
    some = [r["doc_id"] for r in mix_sources(docs, targets, total_tokens=600, weight=heavy).collect()]
    assert len(some) == 200 and 0.66 < sum(k % 2 == 0 for k in some) / 200 < 0.86


def test_no_place_is_crowded(spark):
    from pyspark.sql import functions as F

    from brookmill.operators.ordinals import uniform

    for w in (0.01, 0.1, 1.0, 100.0):
        per = spark.range(200_000).select(place_of(-F.ln(uniform("id")) / F.lit(w)).alias("p")).groupBy("p").count()
        assert per.agg(F.max("count")).first()[0] < 0.002 * 200_000, w


def test_sampling_against_brute_force(spark):
    import math

    docs = spark.createDataFrame([(k, "one " * (1 + k * 7 % 13), "ab"[k % 3 == 0], 0, None) for k in range(900)], DOCS)
    targets = spark.createDataFrame([("a", 0.7, 3, ""), ("b", 0.3, 1, "")], TARGETS)
    from pyspark.sql import functions as F

    size = {r["doc_id"]: r["n_tokens"] for r in mix_sources(docs, targets, total_tokens=10**9).collect()}
    keys = {r["doc_id"]: -math.log(r["u"]) for r in docs.select("doc_id", ((F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float((1 << 52) - 1))).alias("u")).collect()}
    have = {s: sum(n for k, n in size.items() if "ab"[k % 3 == 0] == s) for s in "ab"}
    goals = [("a", 0.7, 3), ("b", 0.3, 1)]
    want = {}
    for s, g in allot(have, goals, largest_total(have, goals)).items():
        epochs, before = int(g // have[s]), 0
        for k in sorted((k for k in size if "ab"[k % 3 == 0] == s), key=lambda k: (keys[k], k)):
            n = epochs + (before + size[k] / 2 <= g - epochs * have[s])
            before += size[k]
            if n:
                want[k] = n
    assert {r["doc_id"]: r["copies"] for r in mix_sources(docs, targets, weight=F.lit(1.0)).collect()} == want


def test_quality():
    import numpy as np

    r = np.random.default_rng(0)
    prose, echo, few = r.integers(0, 3000, 500), np.tile(r.integers(0, 3000, 10), 50), r.integers(0, 3, 500)
    assert quality_of(prose, 0.8) > 0.75 > 0.1 > quality_of(echo, 0.8) and quality_of(few, 0.8) < 0.1
    assert quality_of(np.array([], dtype=int), 0.0) == LEAST_QUALITY and quality_of(prose, 0.0) == LEAST_QUALITY and quality_of(prose[:10], 0.8) == 0.4
