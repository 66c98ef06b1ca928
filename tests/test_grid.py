import datetime as dt
import math

import numpy as np

from brookmill.operators.grid import WIDTH, clip_series, regular_grid

T0 = dt.datetime(2020, 1, 1)
R = "timeseries_path string, timestamp timestamp_ntz, vEgo double, value double"
S = "timeseries_path string, started_at timestamp_ntz, step_ms int, n_steps bigint"


def test_cells_fill_and_marks(spark):
    wave = lambda t: 10 + 3 * math.sin(t / 9)
    rows, series = [], []
    for k in range(30):
        series.append((f"s{k}", T0, 500, 100))
        for i in range(100):
            if (i * 7 + k) % 5:
                rows.append((f"s{k}", T0 + dt.timedelta(milliseconds=500 * i + 40), wave(i + k), 0.0))
    series += [("gap", T0, 1000, 50), ("none", T0, 1000, 5), ("short", T0, 1000, 0), (None, T0, 1000, 3), ("odd", None, 1000, 3)]
    rows += [("gap", T0 + dt.timedelta(seconds=i), float(i), 0.0) for i in range(20)] + [("gap", T0, 2.0, 0.0), ("gap", T0 + dt.timedelta(seconds=60), 1.0, 0.0), ("gap", T0 - dt.timedelta(seconds=1), 1.0, 0.0)]
    rows += [("gap", T0 + dt.timedelta(seconds=30), None, 0.0), ("gap", T0 + dt.timedelta(seconds=31), float("nan"), 0.0), ("gap", T0 + dt.timedelta(seconds=32), float("inf"), 0.0), ("other", T0, 1.0, 0.0), (None, None, 1.0, 0.0)]
    got = {(r["timeseries_path"], r["step"]): (r["value"], r["status"]) for r in regular_grid(spark.createDataFrame(rows, R), spark.createDataFrame(series, S)).collect() if r["timeseries_path"]}
    assert len(got) == 30 * 100 + 50 + 5
    worst = 0.0
    for k in range(30):
        for i in range(100):
            v, status = got[f"s{k}", i]
            if (i * 7 + k) % 5:
                assert status == "observed" and v == wave(i + k)
            elif status == "filled":
                worst = max(worst, abs(v - wave(i + k)))
    assert worst < 0.8
    assert got["gap", 0] == (1.0, "observed") and got["gap", 5] == (5.0, "observed")
    assert got["gap", 32] == (None, "observed") and got["gap", 30][1] != "observed" and got["gap", 45] == (None, "unsupported") and got["none", 2] == (None, "unsupported")


def test_missing_part_is_near_a_held_out_value(spark):
    r = np.random.default_rng(0)
    rows, series, held = [], [], {}
    for k in range(40):
        a, b = r.uniform(5, 30), r.uniform(-0.3, 0.3)
        series.append((f"s{k}", T0, 100, WIDTH * 4))
        for i in range(WIDTH * 4):
            v = a + b * i
            if r.uniform() < 0.2:
                held[f"s{k}", i] = v
            else:
                rows.append((f"s{k}", T0 + dt.timedelta(milliseconds=100 * i), v, 0.0))
    got = {(x["timeseries_path"], x["step"]): x for x in regular_grid(spark.createDataFrame(rows, R), spark.createDataFrame(series, S)).collect()}
    off = [abs(got[k]["value"] - v) / v for k, v in held.items() if got[k]["status"] == "filled"]
    assert len(off) > 0.9 * len(held) and np.median(off) < 0.02


def test_series_of_clips(spark):
    clips = spark.createDataFrame([("a", T0, 100, "x"), ("b", T0, 100, "x"), ("c", T0, 100, "x")], "timeseries_path string, started_at timestamp_ntz, step_ms int, n_steps string")
    m = spark.createDataFrame([("a", [5, 2]), ("a", [7]), ("a", None), ("b", None), ("c", []), ("C", [3]), (None, [4])], "timeseries_path string, ts_shape array<int>")
    assert [(r["timeseries_path"], r["n_steps"]) for r in clip_series(clips, m).collect()] == [("a", 7)]


def test_empty(spark):
    assert regular_grid(spark.createDataFrame([], R), spark.createDataFrame([], S)).count() == 0


def test_long_gaps_are_nearer_than_interpolation(spark):
    r = np.random.default_rng(1)
    n, sources = 192, 40
    shared = np.stack([np.sin(np.arange(n) / 7.0), np.cumsum(r.normal(size=n)) / 4])
    truth = r.normal(size=(sources, 2)) @ shared + r.uniform(5, 20, size=(sources, 1)) + r.normal(scale=0.02, size=(sources, n))
    rows, series, gap = [], [], {}
    for k in range(sources):
        series.append((f"s{k}", T0, 100, n))
        low = int(r.integers(10, n - 50))
        for i in range(n):
            if low <= i < low + 40:
                gap[k, i] = low
            else:
                rows.append((f"s{k}", T0 + dt.timedelta(milliseconds=100 * i), float(truth[k, i]), 0.0))
    got = {(int(x["timeseries_path"][1:]), x["step"]): x for x in regular_grid(spark.createDataFrame(rows, R), spark.createDataFrame(series, S)).collect()}
    assert all(got[c]["status"] == "filled" for c in gap)
    ours = np.array([got[c]["value"] - truth[c] for c in gap])
    line = np.array([np.interp(i, [low - 1, low + 40], [truth[k, low - 1], truth[k, low + 40]]) - truth[k, i] for (k, i), low in gap.items()])
    assert np.sqrt(np.mean(ours**2)) < 0.5 * np.sqrt(np.mean(line**2))


def test_factors_that_do_not_hold_are_not_used(spark):
    r = np.random.default_rng(2)
    rows, series = [], []
    for k in range(20):
        series.append((f"s{k}", T0, 100, 96))
        rows += [(f"s{k}", T0 + dt.timedelta(milliseconds=100 * i), float(v), 0.0) for i, v in enumerate(r.normal(size=96)) if not 40 <= i < 80 and i % 9 != 4]
    got = {(x["timeseries_path"], x["step"]): x for x in regular_grid(spark.createDataFrame(rows, R), spark.createDataFrame(series, S)).collect()}
    assert all(got[f"s{k}", 60]["status"] == "unsupported" and got[f"s{k}", 60]["value"] is None and got[f"s{k}", 42]["status"] == "filled" for k in range(20))
    a, b, c = (got["s3", i]["value"] for i in (12, 13, 14))
    assert abs(b - (a + c) / 2) < 1e-9
