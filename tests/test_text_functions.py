import math
import random
import re

import pytest
from pyspark.sql import functions as F

from brookmill.functions.forecast import forecast_block, forecast_text, number_text, parse_forecast
from brookmill.functions.labels import parse_label
from brookmill.functions.tsblock import linspace_picks, parse_block, strip_block, thin_block

LETTERS, NUMBERS = list("ABCD"), [str(k) for k in range(1, 41)]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["x"] for r in df.select("i", expr(F.col("s")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("labels,cases", [
    (LETTERS, {"A2": ("A", "A"), "the answer is B": ("B", "B"), "BB\nHuman:": (None, "B"), "Bend: the arm movement is performed": (None, "B"), "Zebra": (None, None), "!!!": (None, None), "": (None, None), None: (None, None),
               "xyzzy Bend": (None, None), "Cvel2 ... answer: D": ("D", "D"), "b.": ("B", "B")}),
    (NUMBERS, {"10": ("10", "10"), "3232\n": (None, "32"), "218\nHuman is": (None, "21"), "15 frames": ("15", "15")}), (["1", "2", "3"], {"218": (None, "2")}), ([], {"A": (None, None)}),
    (["left turn", "c++"], {"take the Left Turn now": ("left turn", "left turn"), "I like C++!": ("c++", "c++")}),
])
def test_labels(spark, labels, cases):
    for fallback in (False, True):
        got = column(spark, list(cases), lambda c: parse_label(c, labels, fallback))  # noqa: B023
        assert got == [v[fallback] for v in cases.values()]


def model_label(raw, labels):
    order = sorted(set(labels), key=lambda s: (-len(s), s))
    best = None
    for x in order:
        guard = r"\d" if x.isdigit() else "[A-Za-z]"
        m = re.search(f"(?<!{guard}){re.escape(x)}(?!{guard})", raw, re.I)
        if m and (best is None or m.start() < best[0]):
            best = (m.start(), x)
    if best:
        return best[1]
    m = re.match(r"\s*([A-Za-z]+|[0-9]+)", raw)
    return next((x for x in order if m and m[1].lower().startswith(x.lower())), None)


def test_labels_against_a_model(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("ABCDx12 3.\n") for _ in range(r.randint(0, 9))) for _ in range(400)]
    for labels in (LETTERS, NUMBERS):
        assert column(spark, texts, lambda c: parse_label(c, labels)) == [model_label(t, labels) for t in texts]  # noqa: B023


def test_forecasts(spark):
    texts = {
        "<forecast>\n(2024-01-01: 1, 2)\n(2024-01-02: 3, 4)\n</forecast>": [("2024-01-01", [1, 2]), ("2024-01-02", [3, 4])], "x <FORECAST>(a: 5)(b: 6": [("a", [5])], "<forecast>\n(a: 1)\ngarbage (x)\n(b: 2)": [("a", [1]), ("b", [2])],
        "(t: -1.5, 1e-3, 2.5e+2)": [("t", [-1.5, 0.001, 250.0])], "(2023-12-12, 254, 0.2)": [("2023-12-12", [254, 0.2])], "(timestamp: 2023-12-12: 254, 3)": [("timestamp: 2023-12-12", [254, 3])],
        "(timestamp: 2023-12-12, 254)": [("timestamp", [254])], "(nothing)": None, "": None, None: None, "(a:)": None,
    }
    got = column(spark, list(texts), parse_forecast)
    for (t, want), g in zip(texts.items(), got):
        assert (None if g is None else [(r["label"], list(r["values"])) for r in g]) == want, t
        assert g is None or [r["pos"] for r in g] == list(range(len(g)))
    assert column(spark, ["a <forecast>x \n </forecast> b", "no", None, "<forecast>y"], forecast_block) == ["<forecast>x\n</forecast>", None, None, "<forecast>y\n</forecast>"]
    assert column(spark, ["(a: 1.50, 2)\n(b: 300, 4)"], lambda c: forecast_text(parse_forecast(c), F.lit(0))) == ["<forecast>\n(a: 1.5)\n(b: 300)\n</forecast>"]


def test_numbers_as_text(spark):
    r = random.Random(0)
    values = [0.0, 421.6, 1e-5, 123456.7, 1234567.0, -0.25, 1e20] + [r.uniform(-1, 1) * 10 ** r.randint(-8, 9) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", number_text(F.col("v")).alias("x")).orderBy("i")
    for v, row in zip(values, df.collect()):
        assert math.isclose(float(row["x"]), float(f"{v:g}"), rel_tol=2e-6, abs_tol=1e-300) and ".0" not in row["x"][-2:]
    assert [r["x"] for r in df.take(5)] == ["0", "421.6", "1e-05", "123457", "1.23457e+06"]


BLOCK = "<timeseries>\nformat:\nt(s): vEgo=, aEgo=\n\n25.5: vEgo=6.517, aEgo=null\n30.0: vEgo=1.578, b=-0.55\n31: vEgo=\n</timeseries>"


def test_blocks(spark):
    df = spark.createDataFrame([(1, f"p {BLOCK} q {BLOCK}"), (2, "none"), (3, None)], "k int, p string")
    got = {(r["step"], r["channel"]): r["value"] for r in parse_block(df, ["k"], "p").collect()}
    assert got == {(0, "vEgo"): 6.517, (0, "aEgo"): None, (1, "vEgo"): 1.578, (1, "b"): -0.55, (2, "vEgo"): None}
    assert column(spark, [f"p {BLOCK} q {BLOCK}", "none", None], strip_block) == ["p  q ", "none", None]
    thin = column(spark, [f"p {BLOCK} q {BLOCK}", None, "x", "a </timeseries> <timeseries> 1: b=2.55"], lambda c: thin_block(c, 2, 1))
    assert thin[0] == "p <timeseries>\nformat:\nt(s): vEgo=, aEgo=\n\n25.5: vEgo=6.5, aEgo=null\n31: vEgo=</timeseries> q " + BLOCK and thin[1:] == [None, "x", "a </timeseries> <timeseries> 1: b=2.55"]
    assert column(spark, [f"p {BLOCK}"], lambda c: thin_block(c, 0, 0))[0].count("vEgo=") == 4
    # exact halves go to the even digit, others to the nearer one, as they are stored
    one = "<timeseries>1.05: a=0.25, b=0.35, c=-2.675, d=7\r\n\r\n2: e=1e5\r\n</timeseries>"
    assert column(spark, [one, "<timeseries></timeseries>", "<timeseries>\n</timeseries>"], lambda c: thin_block(c, 5, 1)) == [
        "<timeseries>1.1: a=0.2, b=0.3, c=-2.7, d=7\n\n2: e=1e5</timeseries>", "<timeseries></timeseries>", "<timeseries></timeseries>"]


def test_strict_blocks_raise(spark):
    for text in ("none", "<timeseries>x</timeseries>", "<timeseries>\n1: a=1..2\n</timeseries>"):
        with pytest.raises(Exception, match="no series block|not a number"):
            parse_block(spark.createDataFrame([(1, text)], "k int, p string"), ["k"], "p", strict=True).collect()
    assert parse_block(spark.createDataFrame([(1, BLOCK)], "k int, p string"), ["k"], "p", strict=True).count() == 5


def test_labels_of_any_script(spark):
    assert column(spark, ["ÄPFEL sind da", "да", "ДА!"], lambda c: parse_label(c, ["äpfel", "Да"])) == ["äpfel", "Да", "Да"]


def test_picks(spark):
    pairs = [(n, m) for n in range(2, 40) for m in range(1, 14)]
    df = spark.createDataFrame(pairs, "n int, m int").select("n", "m", linspace_picks(F.col("n"), F.col("m")).alias("x"))
    for r in df.collect():
        n, m = r["n"], r["m"]
        want = [0] if m == 1 else list(dict.fromkeys(n - 1 if i == m - 1 else round(i * ((n - 1) / (m - 1))) for i in range(m)))
        assert r["x"] == want
