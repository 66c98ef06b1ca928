import datetime as dt
import random

from brookmill.operators.spikes import flag_spikes

T0 = dt.datetime(2020, 1, 1, 5, 59, 0)
SCHEMA = "reading_id bigint, vehicle_id string, timeseries_path string, timestamp timestamp_ntz, vEgo double, kind string, piece int"


def table(spark, series, vehicle="v"):
    rows, k = [], 0
    for name, values in series.items():
        for i, v in enumerate(values):
            rows.append((k, vehicle, name, T0 + dt.timedelta(seconds=i), v, "x", 1))
            k += 1
    return spark.createDataFrame(rows, SCHEMA), rows


def noisy(n, seed, level=20.0):
    r = random.Random(seed)
    return [round(level + r.gauss(0, 0.1), 3) for _ in range(n)]


def test_kinds(spark):
    s = {f"s{k}": noisy(120, k) for k in range(6)}
    s["spike"] = noisy(120, 50)
    for k in (60, 61):
        s["spike"][k] += 6
    s["stuck"] = noisy(30, 51) + [20.5] * 25 + noisy(30, 52)
    s["wild"] = noisy(40, 53)
    s["wild"][10], s["wild"][20], s["wild"][25], s["wild"][30] = -1.0, float("inf"), None, float("nan")
    s["halt"] = [float(max(0, 20 - k)) for k in range(25)] + [0.0] * 60
    s["brake"] = noisy(30, 54) + [20 - 1.2 * k for k in range(15)] + noisy(30, 55, 2.0)
    df, rows = table(spark, s)
    got = {r["reading_id"]: r["kind"] for r in flag_spikes(df).collect()}
    want = {}
    for k, _, name, at, *_ in rows:
        i = int((at - T0).total_seconds())
        if name == "spike" and i in (60, 61):
            want[k] = "spike"
        if name == "stuck" and 30 <= i < 55:
            want[k] = "stuck"
        if name == "wild" and i in (10, 20):
            want[k] = "impossible"
    assert got == want


def test_resent_copies_and_dirty_keys(spark):
    values = noisy(200, 1)
    values[100] += 8
    df, rows = table(spark, {"s": values})
    more = [(1000, "v", "s", T0 + dt.timedelta(seconds=100), values[100], None, None), (1001, "v", None, None, 5.0, None, None), (1002, None, None, None, -5.0, None, None), (1003, None, "t", T0, 3.0, None, None)]
    got = {r["reading_id"]: r["kind"] for r in flag_spikes(df.union(spark.createDataFrame(more, SCHEMA))).collect()}
    assert got == {100: "spike", 1000: "spike", 1002: "impossible"}


def test_pieces_change_nothing(spark):
    values = noisy(3000, 3)
    for k in (17, 500, 501, 1799, 1800, 2500):
        values[k] -= 7
    values[1180:1230] = [21.5] * 50  # a run over the ends of pieces
    df, _ = table(spark, {"s": values, "t": noisy(30, 4)})
    whole = {tuple(r) for r in flag_spikes(df).collect()}
    assert len(whole) == 56
    for piece in (600, 11, 1):
        assert {tuple(r) for r in flag_spikes(df, piece=piece).collect()} == whole, piece


def test_readings_may_be_hours_apart(spark):
    values = noisy(400, 5)
    for k in (60, 61, 200):
        values[k] += 6
    values[300:330] = [20.7] * 30
    rows = [(k, "v", "s", T0 + dt.timedelta(hours=9 * k + k % 3), v, "x", 1) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {60, 61, 200, *range(300, 330)}
    for piece in (200_000, 25):
        assert {r["reading_id"] for r in flag_spikes(df, piece=piece).where("kind <> 'jump'").collect()} == want


def test_empty(spark):
    assert flag_spikes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spikes_of_any_length(spark):
    for piece in (200_000, 100):
        s = {f"s{k}": noisy(120, 100 + k) for k in range(6)} | {"up": noisy(900, 110), "near": noisy(200, 111), "shift": noisy(80, 112) + noisy(80, 113, 28.0)}
        want = set()
        for low, n, by in ((20, 4, 6), (60, 5, -7), (100, 8, 6), (150, 40, -8), (560, 120, 9)):
            for k in range(low, low + n):
                s["up"][k] += by
                want.add(("up", k))
        for low in (50, 60):  # the calm readings between two spikes are right
            for k in range(low, low + 5):
                s["near"][k] += 6
                want.add(("near", k))
        s["brake"] = noisy(30, 114) + [20 - 1.5 * k for k in range(8)] + noisy(12, 115, 8.0) + [8 + 1.5 * k for k in range(8)] + noisy(30, 116)
        df, rows = table(spark, s)
        named = {r[0]: (r[2], int((r[3] - T0).total_seconds())) for r in rows}
        assert {named[r["reading_id"]] for r in flag_spikes(df, piece=piece).where("kind = 'spike'").collect()} == want


def test_a_step_that_is_not_taken_back_is_a_jump(spark):
    s = {f"s{k}": noisy(120, 200 + k) for k in range(6)} | {"up": noisy(80, 210) + noisy(80, 211, 28.0), "down": noisy(60, 212) + noisy(80, 213, 11.0), "spike": noisy(120, 214)}
    for k in range(40, 46):
        s["spike"][k] += 6
    # as much change, but over a gap in time or as real braking
    s["brake"] = noisy(30, 215) + [20 - 1.5 * k for k in range(8)] + noisy(30, 216, 8.0)
    s["gap"] = noisy(30, 217) + [None] * 60 + noisy(30, 218, 26.0)
    df, rows = table(spark, s)
    named = {r[0]: (r[2], int((r[3] - T0).total_seconds())) for r in rows}
    got = {named[r["reading_id"]]: r["kind"] for r in flag_spikes(df).collect()}
    assert got == {("up", 80): "jump", ("down", 60): "jump"} | {("spike", k): "spike" for k in range(40, 46)}
