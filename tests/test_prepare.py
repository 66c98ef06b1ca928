import math
import random

import pytest
from pyspark.sql import functions as F

from brookmill.operators import conversation as V
from brookmill.operators import layout as L
from brookmill.operators import normalize as N
from brookmill.operators.batching import plan_batches, plan_steps
from brookmill.operators.lengths import length_summary, video_tokens
from brookmill.operators.ordinals import ordinals, uniform


def model_tokens(w, h, fps, n):
    if n is None or n <= 0 or not w or not h or w <= 0 or h <= 0 or max(w, h) > 200 * min(w, h):
        return 0
    low, high = 64 * 784, 128 * 784
    rh, rw = round(h / 28) * 28, round(w / 28) * 28
    if rh * rw > high:
        b = math.sqrt(h * w / high)
        rh, rw = max(28, math.floor(h / b / 28) * 28), max(28, math.floor(w / b / 28) * 28)
    elif rh * rw < low:
        b = math.sqrt(low / (h * w))
        rh, rw = math.ceil(h * b / 28) * 28, math.ceil(w * b / 28) * 28
    k = 2
    if fps and fps > 0:
        most = math.floor(min(80, n) / 2) * 2
        k = max(2, math.floor(min(min(max(n / fps, 4), most), n) / 2) * 2)
    return (k // 2) * (rh // 14) * (rw // 14) // 4


def test_video_tokens_against_a_model(spark):
    r = random.Random(0)
    rows = [(i, (r.choice([14, 70, 98, 320, 640, 1920, 3000, 0, -1, 9000]), r.choice([14, 42, 240, 480, 1080, 0]), r.choice([0.0, 10.0, 29.97, None]), r.choice([None, 0, 1, 3, 30, 127, 5000]), 1.0)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, m struct<width:int,height:int,source_fps:double,nb_frames:int,duration:double>").select("i", video_tokens(F.col("m")).alias("n"))
    got = {x["i"]: x["n"] for x in df.collect()}
    for i, (w, h, fps, n, _) in rows:
        assert got[i] == model_tokens(w, h, fps, n), rows[i]


def test_summary_of_lengths(spark):
    r = random.Random(0)
    rows = [(g, r.randint(1, 30)) for g in "aabbb" * 40 + "c"] + [("d", None)]
    for x in length_summary(spark.createDataFrame(rows, "g string, n int"), "n", ["g"]).collect():
        s = sorted(n for g, n in rows if g == x["g"])
        assert (x["n"], x["min_len"], x["p50"], x["p95"], x["max_len"]) == (len(s), s[0], s[len(s) // 2], s[int(len(s) * 0.95)], s[-1])


def test_ordinals(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    rows = ordinals(df, "k", ["g"], uniform(F.col("id")), ["id"], places=16).collect()
    for g in range(3):
        assert sorted(r["k"] for r in rows if r["g"] == g) == list(range(len(range(g, 1000, 3))))


def test_batches(spark):
    lengths = {(t, i): (200 if i % 3 == 0 else 50) for t, n in enumerate((8, 50, 200)) for i in range(n)}
    rows = [(k, f"t{t}", n) for k, ((t, _), n) in enumerate(lengths.items())] + [(999, None, 5000), (1000, None, None)]
    df = spark.createDataFrame(rows, "id bigint, task string, n int")
    plan = plan_batches(df, "id", "n", "task", 2000, 8, 32)
    found = plan.collect()
    assert sorted(r["item"] for r in found) == sorted(r[0] for r in rows)
    batches = {}
    for r in found:
        batches.setdefault((r["task"], r["bucket"], r["batch"]), []).append(r["len"])
    assert all(len(b) == 1 or len(b) * max(b) <= 2000 and len(b) <= 8 for b in batches.values())
    assert {tuple(r) for r in plan_batches(df, "id", "n", "task", 2000, 8, 32).collect()} == {tuple(r) for r in found}
    assert {tuple(r) for r in plan_batches(df, "id", "n", "task", 2000, 8, 32, epoch=1).collect()} != {tuple(r) for r in found}
    steps = {}
    for r in plan_steps(plan, 2).collect():
        steps.setdefault(r["step"], {}).setdefault(r["rank"], set()).add(r["task"])
    assert sorted(steps) == list(range(len(steps))) and all(set(s) == {0, 1} and s[0] == s[1] and len(s[0]) == 1 for s in steps.values())
    with pytest.raises(ValueError):
        plan_batches(df, "id", "n", "task", 0)


def test_normalisation(spark):
    lines = ['{"video_id": "v"}', '{"id": "i", "video_id": "v", "task": null}', '{"id": "i", "task": "prediction"}', "{}", "broken"]
    rows = N.normalize_rows(spark.createDataFrame([(x,) for x in lines], "line string"), "line").collect()
    assert [(r["id"], r["task"], r["renamed"]) for r in rows] == [("v", "classification", True), ("v", None, False), ("i", "prediction", False), (None, "classification", False), (None, None, False)]
    with pytest.raises(ValueError):
        N.union_sources({})


def test_channels_that_do_not_match_raise(spark):
    df = spark.createDataFrame([("a", [(0, "t", [1.0, 2.0])], ["x", "y"])], "id string, parsed array<struct<pos:int,label:string,values:array<double>>>, names array<string>")
    out = N.explode_channels(df, "parsed", "names").collect()
    assert [(r["id"], r["channel_name"], r["target"][0]["value"]) for r in out] == [("a__ch0", "x", 1.0), ("a__ch1", "y", 2.0)]
    with pytest.raises(Exception, match="don't match"):
        N.explode_channels(df.withColumn("names", F.array(F.lit("x"))), "parsed", "names").collect()


def test_conversations(spark):
    df = spark.createDataFrame([("p", "a", "v.mp4", ["i.png"], "s.csv", "t"), ("p", None, None, None, None, None)], "prompt string, answer string, video string, images array<string>, series string, task string")
    c = V.mark_series(V.build_conversation(*(F.col(x) for x in df.columns), timeseries=True))
    a, b = df.select(c.alias("c")).collect()
    assert [(m["role"], [e["type"] for e in m["content"]]) for m in a["c"]] == [("user", ["video", "image", "text", "text"]), ("assistant", ["text"])]
    assert len(b["c"]) == 1 and V.TS_PLACEHOLDER in b["c"][0]["content"][0]["value"]
    with pytest.raises(Exception, match="placeholder"):
        spark.range(1).select(V.expand_placeholder(F.lit("none"), F.lit(2))).collect()


MARKS = {"video": 1, "series": 2, "ts_start": 3, "ts_end": 4, "vision_start": 900, "vision_end": 901}


def test_positions():
    alone = L.positions([50, 50, 3, 2, 2, 2, 2, 4, 50], MARKS, 2, [], [], 2, 1.0).T.tolist()
    assert alone == [[0, 0, 0], [1, 1, 1], [2, 2, 2], [3, 3, 3], [3, 4, 4], [4, 3, 3], [4, 4, 4], [5, 5, 5], [6, 6, 6]]
    woven = L.positions([50, 900, 3, 1, 1, 1, 1, 2, 1, 1, 1, 1, 2, 4, 901, 50], MARKS, 1, [(2, 4, 4)], [1.0], 2, 1.0).T.tolist()
    assert woven[1:4] == [[1, 1, 1], [2, 2, 2], [3, 3, 3]] and woven[6:9] == [[3, 4, 4], [3, 3, 3], [4, 3, 3]] and woven[12:] == [[4, 3, 3], [5, 5, 5], [6, 6, 6], [7, 7, 7]]
    assert L.positions([50, 900, 1, 50], MARKS, 1, [], [], 2, 1.0).T.tolist() == [[k] * 3 for k in range(4)]
    assert L.positions([], MARKS, 1, [], [], 2, 1.0).shape == (3, 0)


def test_weaving_and_masks(spark):
    df = spark.createDataFrame([([9, 1, 1, 1, 1, 1, 1, 8, 3, 2, 2, 2, 2, 4, 7],), ([9, 8],)], "ids array<int>")
    lit = [F.lit(x) for x in (3, 2, 2, 2)]
    a, b = [r[0] for r in df.select(L.weave_tokens(F.col("ids"), 1, 2, 3, 4, *lit)).collect()]
    assert a == [9, 3, 1, 1, 2, 2, 1, 1, 2, 2, 1, 1, 4, 8, 7] and b == [9, 8]
    with pytest.raises(Exception, match="length"):
        df.select(L.weave_tokens(F.col("ids"), 1, 2, 3, 4, F.lit(2), F.lit(2), F.lit(2), F.lit(2))).collect()
    df = spark.createDataFrame([([5, 6, 1, 7, 5, 6, 2, 3, 7, 9],), ([1, 2, 3],), ([1],)], "ids array<int>")
    assert [r[0] for r in df.select(L.mask_labels(F.col("ids"), [5, 6], 7)).collect()] == [[-100] * 6 + [2, 3, 7, -100], [-100] * 3, [1]]
    with pytest.raises(Exception, match="horizon"):
        spark.range(1).select(L.pad_target(F.array(F.lit(1.0), F.lit(2.0)), 1)).collect()
