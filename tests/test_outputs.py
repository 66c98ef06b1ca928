import json

import pytest
from pyspark.sql import functions as F

from brookmill import cli
from brookmill.functions.forecast import reply_text, step_text
from brookmill.operators import annotate as A
from brookmill.operators import classification as C
from brookmill.operators import normalize as N
from brookmill.operators.lengths import smart_resize
from brookmill.operators.scoring import EchoScorer, backend, out_of_memory, register, score_batch
from brookmill.sources import outputs as O
from brookmill.sources import runs as R
from brookmill.sources.series import parse_series


def scores(spark, rows, by=("run",)):
    df = spark.createDataFrame(rows, "run string, gt string, pred string")
    matrix = C.confusion(df, ["A", "B"], list(by))
    report = C.class_report(matrix, list(by))
    return C.overall(df, report, ["A", "B"], list(by)), report, matrix


def test_class_text_and_document(spark):
    parts = scores(spark, [("r", "A", "A"), ("r", "A", "B"), ("r", "B", "B"), ("r", "B", None), (None, "A", "A")])
    text = {r["run"]: r["report"].split("\n") for r in O.class_text(*parts, ["run"]).collect()}
    assert text["r"][0] == "n=4  correct=2  unparseable=1  unknown_gt=0" and text["r"][1] == "Accuracy    : 0.5000" and text["r"][7] == "       A     1.0000     0.5000     0.6667          2"
    assert text["r"][-2:] == ["         A      1      1      0", "         B      0      1      1"] and text["r"][-3] == "   gt/pred      A      B   None" and len(text[None]) == len(text["r"])
    docs = {r["run"]: json.loads(r["json"]) for r in O.class_documents(*parts, ["run"]).collect()}
    assert docs["r"]["confusion_matrix"]["B"] == {"A": 0, "B": 1, "None": 1} and docs["r"]["per_class"]["A"]["support"] == 2 and docs["r"]["labels"] == ["A", "B"] and docs[None]["total"] == 1
    runs = spark.createDataFrame([("r", '{"failed": 3, "succeeded": 4}')], "run string, json string")
    full = {r["run"]: json.loads(r["json"]) for r in O.with_run(O.class_documents(*parts, ["run"]), runs, ["run"]).collect()}
    assert full["r"]["infer"] == {"failed": 3, "succeeded": 4} and full["r"]["failed"] == 3 and full["r"]["total"] == 4 and "infer" not in full[None]


def test_runs_without_a_name_are_in_every_table(spark):
    overall, report, _ = scores(spark, [(None, "A", "A"), (None, "B", "A")])
    assert [tuple(r) for r in overall.select("run", "total", "correct").collect()] == [(None, 2, 1)] and report.count() == 2


def test_forecast_report(spark):
    s = spark.createDataFrame([("r", 3, 2, 1, 2 / 3, 0.125, 0.1, None, 1.0), ("x", 1, 0, 1, 0.0, None, None, None, None)], "run string, total bigint, succeeded bigint, n_failed bigint, parse_rate double, mae double, mse double, mape double, pcc double")
    c = spark.createDataFrame([("r", 0, 0.125, 0.1, None)], "run string, channel int, mae double, mse double, mape double")
    text = {r["run"]: r["report"].split("\n") for r in O.forecast_text_report(s, c, ["run"]).collect()}
    assert text["r"][0] == "n=3  succeeded=2  failed=1  parse_rate=0.6667" and text["r"][2] == "MAE  : 0.125000" and text["r"][4] == "MAPE : nan%" and text["r"][-1] == "   0     0.125000     0.100000          nan" and text["x"][-1] == "PCC  : nan"


def test_commands(spark, tmp_path, capsys):
    f = tmp_path / "a.jsonl"
    f.write_text('{"video_id":"v","id":"old","n":[1,{"x":null}]}\n\n{"id":"b","task":null}\n{"id":"c"}\n')
    cli.main(["normalize", "--in", str(f), "--out-dir", str(tmp_path / "out")], spark)
    got = [json.loads(x) for p in sorted((tmp_path / "out" / "a.jsonl").glob("part*")) for x in p.read_text().splitlines()]
    assert got == [{"id": "v", "n": [1, {"x": None}], "task": "classification"}, {"id": "b", "task": None}, {"id": "c", "task": "classification"}] and "'n_renamed': 0" in capsys.readouterr().out
    (tmp_path / "h.csv").write_text("timestamp,x,y\n0,1,2\n1,,4.5\n")
    s = tmp_path / "s.jsonl"
    rows = [{"id": "f", "task": "prediction", "answer": "<forecast>(t1: 1, 2)(t2: 3, 4)</forecast>", "timeseries_path": str(tmp_path / "h.csv"), "prompt": "P", "more": 7}, {"id": "k", "task": "classification", "answer": "A", "prompt": "Q"}]
    s.write_text("".join(json.dumps(r) + "\n" for r in rows))
    cli.main(["channels", "--in", str(s), "--series-dir", str(tmp_path / "series")], spark)
    assert capsys.readouterr().out.strip().endswith("2 3")
    got = [json.loads(x) for p in sorted((tmp_path / "s.percha.jsonl").glob("part*")) for x in p.read_text().splitlines()]
    assert [g["id"] for g in got] == ["f__ch0", "f__ch1", "k"] and got[1]["answer"] == "<forecast>\n(t1: 2)\n(t2: 4)\n</forecast>" and got[0]["ts_shape"] == [2, 1] and got[1]["more"] == 7
    assert (tmp_path / "series" / "f__ch1.csv").read_text() == "y\n2.0\n4.5\n" and (tmp_path / "series" / "f__ch0.target.csv").read_text() == "x\n1.0\n3.0\n" and (tmp_path / "series" / "f__ch0.csv").read_text() == "x\n1.0\n\n"


def test_series_texts():
    assert parse_series(b"").num_rows == 0 and parse_series(b"timestamp\n1\n").num_rows == 0
    got = parse_series(b"a,b\n1, 2 \n3\nnull,\n").to_pydict()
    assert got["value"] == [1.0, 3.0, None, 2.0, None, None] and got["step"] == [0, 1, 2, 0, 1, 2]
    for bad in (b"a\nx\n", b"a\n1,2\n"):
        with pytest.raises(ValueError):
            parse_series(bad)


def test_scorers_by_name():
    register("late", "brookmill.operators.scoring:EchoScorer")
    assert isinstance(backend("late", largest=2), EchoScorer) and out_of_memory(RuntimeError("CUDA out of memory")) and not out_of_memory(ValueError("x"))
    failed = score_batch(EchoScorer(), [{"id": "a", "answer": None}])[0]
    assert failed[3] and "no answer" in failed[4] and "Traceback" in failed[5] and score_batch(EchoScorer(), [{"id": "a", "answer": "x"}])[0][4:] == (None, None)


def test_kept_lengths(spark, tmp_path):
    path = str(tmp_path / "lengths")
    df = spark.range(4).select(F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("length_key"), F.col("id").alias("length"))
    assert A.load_lengths(spark, path) is None
    A.save_lengths(df, path)
    assert A.load_lengths(spark, path, 4).count() == 3 and A.load_lengths(spark, path, 5) is None


def test_small_parts(spark):
    one = spark.range(1)
    assert one.select(step_text(F.array(F.lit(1.5), F.lit(2.0)))).first()[0] == "<forecast>\n(0: 1.5)\n(1: 2)\n</forecast>" and one.select(step_text(F.lit(None).cast("array<double>"))).first()[0] is None
    assert one.select(reply_text(F.lit('{"output": [{"content": null}, {"content": [{"text": "hi"}]}]}'))).first()[0] == "hi"
    assert R.named_sources(["a:b:c"]) == {"a": "b:c"}
    with pytest.raises(ValueError):
        R.named_sources(["plain"])
    with pytest.raises(Exception, match="aspect"):
        one.select(*smart_resize(F.lit(1), F.lit(500), 28, 100, 10**6, strict=True)).collect()
    lines = spark.createDataFrame([('{"raw": null}',), ('{"x": 1}',), ("bad",)], "value string")
    assert N.having_key(lines, "raw").count() == 1
    m = spark.createDataFrame([('{"mae": 1.5}',), ("{",)], "j string").select(F.try_parse_json("j").alias("metrics"))
    assert [r[0] for r in m.select(R.metric("mae", 0.0)).collect()] == [1.5, 0.0]
