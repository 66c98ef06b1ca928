import math
import random

import numpy as np
from pyspark.sql import functions as F

from brookmill.functions.forecast import parse_forecast
from brookmill.functions.labels import parse_label
from brookmill.operators import classification as C
from brookmill.operators.align import align_forecast
from brookmill.operators.regression import channel_scores, dataset_scores, score_rows

SCHEMA = "run string, id string, g string, p string"


def scored(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return score_rows(df.withColumn("aligned", align_forecast(parse_forecast(F.col("g")), parse_forecast(F.col("p")))))


def block(*rows):
    return "<forecast>\n" + "\n".join(f"({k}: {', '.join(map(str, v))})" for k, v in rows) + "\n</forecast>"


def test_dataset_of_two_and_one_unparsed(spark):
    rows = [("r", "a", block(("t1", [1, 2]), ("t2", [3, 4])), block(("t1", [1.5, 2]), ("t2", [3, 4.5]))), ("r", "b", block(("t1", [10, 20]), ("t2", [30, 40])), block(("t1", [10, 20]), ("t2", [30, 40]))), ("r", "c", block(("t1", [1])), "model gave up")]
    s = scored(spark, rows)
    r = dataset_scores(s, ["run"]).first()
    assert (r["total"], r["succeeded"], r["n_failed"], r["channels"]) == (3, 2, 1, 2) and r["parse_rate"] == 2 / 3 and r["mae"] == 0.125
    assert {x["id"]: x["score"]["mae"] for x in s.collect()} == {"a": 0.25, "b": 0.0, "c": None}
    assert {(x["channel"], x["n_rows"], x["mae"]) for x in channel_scores(s, ["run"]).collect()} == {(0, 2, 0.125), (1, 2, 0.125)}


def test_alignment(spark):
    cases = {
        "reordered": (block(("a", [1]), ("b", [2])), block(("b", [2]), ("a", [1])), "by_label", 0, False, 0.0),
        "relabelled": (block(("a", [1]), ("b", [2])), block(("x", [1]), ("y", [2])), "positional", 2, False, 0.0),
        "short": (block(("a", [1]), ("b", [2]), ("c", [3])), block(("x", [1]), ("y", [2])), "positional", 3, True, 0.0),
        "last of a label": (block(("a", [1])), block(("a", [9]), ("a", [2])), "by_label", 0, True, 1.0),
        "narrow": (block(("a", [1, 5])), block(("a", [2])), "by_label", 0, False, 1.0),
    }
    for r in scored(spark, [("r", k, g, p) for k, (g, p, *_) in cases.items()]).collect():
        _, _, how, missing, mismatch, mae = cases[r["id"]]
        a = r["aligned"]
        assert (a["alignment"], a["missing_labels"], a["length_mismatch"], r["score"]["mae"]) == (how, missing, mismatch, mae), r["id"]


def test_errors_against_numpy(spark):
    r = random.Random(0)
    rows, want = [], {}
    for k in range(60):
        n, w = r.randint(1, 8), r.randint(1, 3)
        g = [[r.choice([0, r.randint(-9, 9), round(r.uniform(-5, 5), 2)]) for _ in range(w)] for _ in range(n)]
        p = [[round(r.uniform(-5, 5), 2) for _ in range(w)] for _ in range(n)]
        rows.append(("r", str(k), block(*((f"t{i}", x) for i, x in enumerate(g))), block(*((f"t{i}", x) for i, x in enumerate(p)))))
        a, b = np.array(g, float), np.array(p, float)
        off = np.abs(a) >= 1e-8
        cc = [np.corrcoef(a[:, c], b[:, c])[0, 1] for c in range(w) if n >= 2 and np.ptp(a[:, c]) > 0 and np.ptp(b[:, c]) > 0]
        want[str(k)] = (np.abs(a - b).mean(), ((a - b) ** 2).mean(), (np.abs(a - b)[off] / np.abs(a)[off]).mean() * 100 if off.any() else None, int((~off).sum()), np.mean(cc) if cc else None)
    for x in scored(spark, rows).collect():
        s = x["score"]
        for got, exp in zip((s["mae"], s["mse"], s["mape"], s["mape_skipped"], s["pcc"]), want[x["id"]]):
            assert got == exp or math.isclose(got, exp, rel_tol=1e-9, abs_tol=1e-12)


def test_classification(spark):
    df = spark.createDataFrame([("r", "A", "A"), ("r", "A", "B"), ("r", "B", "B"), ("r", "B", None), ("r", "Z", "A"), ("r", "A", "Q"), ("r", None, None)], "run string, gt string, pred string")
    m = C.confusion(df, ["A", "B", "C"], ["run"])
    cells = {(r["gt"], r["pred"]): r["n"] for r in m.collect()}
    assert len(cells) == 12 and cells["A", None] == 1 and cells["B", None] == 1 and cells["A", "B"] == 1 and cells["C", "C"] == 0
    report = C.class_report(m, ["run"])
    per = {r["label"]: r for r in report.collect()}
    assert per["A"]["precision"] == 1.0 and per["A"]["recall"] == 1 / 3 and per["B"]["precision"] == 0.5 and per["C"]["f1"] == 0.0 and per["C"]["support"] == 0
    o = C.overall(df, report, ["A", "B", "C"], ["run"]).first()
    assert (o["total"], o["correct"], o["unparseable"], o["unknown_gt"], o["accuracy"]) == (7, 2, 1, 2, 2 / 7)
    assert math.isclose(o["uar"], (1 / 3 + 1 / 2 + 0) / 3)
    assert C.overall(df, C.class_report(C.confusion(df, [], ["run"]), ["run"]), [], ["run"]).count() == 0


def test_rollups(spark):
    df = spark.createDataFrame([("r", "A", "A", False), ("r", "B", "", None), ("r", "C", "C", True), ("r", None, None, False)], "run string, ground_truth string, prediction string, failed boolean")
    x = C.inference_rollup(df, ["run"]).first()
    assert (x["total"], x["succeeded"], x["n_failed"], x["success_rate"], x["accuracy"], x["accuracy_succeeded"]) == (4, 3, 1, 0.75, 0.25, 1 / 3)
    assert {(r["bucket"], r["n"]) for r in C.distribution(df, ["run"], "prediction").collect()} == {("A", 1), ("_NONE_", 2), ("_FAILED_", 1)}
    assert C.label_set(df) == ["A", "B"] and C.label_set(df, failed=None) == ["A", "B", "C"]
    assert {(r["ground_truth"], r["correct"], r["total"]) for r in C.per_option(df, ["run"], "ground_truth", "prediction").collect()} == {("A", 1, 1), ("B", 0, 1), ("C", 1, 1), (None, 1, 1)}
    assert C.reparse_changes(df, parse_label(F.col("prediction"), ["A"]), ["run"]).first()["n_changed"] == 2


def test_tasks(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "prediction"), ("b", 1, "classification"), ("b", 2, "prediction"), ("c", 1, "")], "s string, n int, task string")
    assert {(r["s"], r["task"]) for r in C.detect_task(df, "n", ["s"]).collect()} == {("a", "prediction"), ("b", "classification"), ("c", "classification")}
    assert {(r["s"], r["task"]) for r in C.single_task(df, ["s"]).collect()} == {("a", "prediction"), ("b", "classification"), ("c", "classification")}
