import json

import pytest
from pyspark.sql import functions as F

from brookmill.operators.scoring import EchoScorer, backend, score_batch, score_calls, score_rows, with_retry
from brookmill.sources import manifest as M
from brookmill.sources.runs import long_metrics, read_metrics, summary, task_of_dataset, with_sidecar
from brookmill.sources.series import pad_series, read_series, series_shape, single_channel
from brookmill.streaming.resume import score_stream


def test_samples(spark, tmp_path):
    a, b = tmp_path / "one.tag.jsonl", tmp_path / "two.jsonl"
    a.write_text('{"id":"abc","task":"classification","video_path":"/v.mp4","prompt":"P","answer":"A","ts_shape":[3,2],"more":1}\n\n{"id":"i","image_path":["/a","/b"],"prompt":"é","answer":"B","video_meta":{"width":2,"height":3,"source_fps":1.5,"nb_frames":4,"duration":2}}\n')
    b.write_text('{"id":"s","image_path":"/c","prompt":"P","answer":"A"}\n')
    rows = {r["id"]: r for r in M.read_samples(spark, [str(a), str(b)]).collect()}
    assert rows["abc"]["ts_shape"] == [3, 2] and rows["abc"]["image_path"] == [] and rows["abc"]["extra_keys"] == "more" and rows["abc"]["source_name"] == "one"
    assert rows["i"]["image_path"] == ["/a", "/b"] and rows["i"]["video_meta"]["nb_frames"] == 4 and rows["i"]["prompt"] == "é" and rows["s"]["image_path"] == ["/c"] and rows["s"]["source_id"] == 1
    b.write_text("{broken\n")
    with pytest.raises(Exception, match="not a JSON object"):
        M.read_samples(spark, str(b)).collect()
    assert M.read_samples(spark, str(b), strict=False).count() == 0
    with pytest.raises(ValueError):
        M.read_samples(spark, [])


def test_predictions_and_atomic_rewrite(spark, tmp_path):
    assert M.read_predictions(spark, str(tmp_path / "none")).count() == 0
    f = tmp_path / "p.jsonl"
    f.write_text('{"id":"a","failed":false}\nnot json\n{"id":null}\n')
    df = M.read_predictions(spark, str(f))
    assert sorted(str(r["id"]) for r in df.collect()) == ["None", "a"]
    out = str(tmp_path / "out")
    M.write_json_atomically(df, out)
    M.write_json_atomically(spark.read.schema("id string").json(out).withColumn("id", F.upper("id")), out)
    assert sorted(str(r["id"]) for r in spark.read.schema("id string").json(out).collect()) == ["A", "None"]


def test_extra_fields_survive_and_lines_are_numbered(spark, tmp_path):
    f = tmp_path / "big.jsonl"
    f.write_text("".join(f'{{"id":"i{k}","answer":"é","more":{{"a":[{k},null]}},"n":{k}.5}}\n' + ("\n" if k % 7 == 0 else "") for k in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    rows = M.read_samples(spark, str(f))
    first = [(r["line_no"], r["id"]) for r in M.first_lines(rows, 9).orderBy("line_no").collect()]
    every = {r["line_no"]: r["id"] for r in rows.collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert first == [(1, "i0"), (3, "i1"), (4, "i2"), (5, "i3"), (6, "i4"), (7, "i5"), (8, "i6"), (9, "i7")] and len(every) == 400 and every[400 + 57] == "i399"
    out = str(tmp_path / "out")
    M.write_samples(rows, out, ["line_no"])
    back = [json.loads(x["value"]) for x in spark.read.text(out).collect()]
    assert sorted(b["n"] for b in back) == [k + 0.5 for k in range(400)] and all(b["more"] == {"a": [int(b["n"]), None]} and b["answer"] == "é" for b in back)
    M.write_samples(M.read_samples(spark, out), out)
    assert M.read_samples(spark, out).where("extra_keys = 'more,n'").count() == 400


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    out = tmp_path / "out"
    M.write_json_atomically(spark.range(3), str(out))
    with pytest.raises(Exception, match="boom"):
        M.write_json_atomically(spark.range(3).select(F.raise_error(F.lit("boom")).alias("x")), str(out))
    assert spark.read.json(str(out)).count() == 3 and [x.name for x in tmp_path.iterdir()] == ["out"]
    out.rename(tmp_path / "out.old")  # a crash between the two moves
    M.write_json_atomically(spark.range(5), str(out))
    assert spark.read.json(str(out)).count() == 5 and [x.name for x in tmp_path.iterdir()] == ["out"]


def test_file_names():
    names = ["a.jsonl", "a.x.jsonl", "b.x.jsonl", "b.percha.jsonl", "c.x.jsonl", "c.y.jsonl"]
    assert [M.dataset_file(names, n) for n in "abcd"] == ["a.jsonl", "b.x.jsonl", "c.x.jsonl", "d.jsonl"]
    assert [M.dataset_stem(p) for p in ("d/a.jsonl", "d/a.x.jsonl", "a.percha.jsonl")] == ["a", "a", "a.percha"]
    assert M.derived_path("d/a.x.jsonl") == "d/a.percha.x.jsonl" and M.derived_path("a.jsonl") == "a.percha.jsonl"


def test_series_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,a,b\n0,1.0,10.0\n1,2.0,\n2,3.0,30.0\n")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n3,null\n")
    long = read_series(spark, str(tmp_path)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    assert long.where("name = 'a.csv' and channel = 'b'").orderBy("step").select("value").collect() == [(10.0,), (None,), (30.0,)]
    padded = {(r["name"], r["channel_index"]): r for r in pad_series(long, ["name"], []).collect()}
    assert len(padded) == 4 and padded["b.csv", 0]["n_steps"] == 2 and padded["b.csv", 0]["values"][:2] == [1.0, 3.0] and padded["b.csv", 0]["values"][2] != padded["b.csv", 0]["values"][2] and padded["a.csv", 1]["n_channels"] == 2
    with pytest.raises(Exception, match="one channel"):
        single_channel(long, ["name"]).collect()
    texts = spark.createDataFrame([(0, "timestamp,a\n1,2\n\n3,4\n"), (1, ""), (2, None), (3, "a,b,c")], "i int, t string").select("i", series_shape(F.col("t")).alias("s")).orderBy("i")
    assert [r["s"] for r in texts.collect()] == [[3, 1], None, None, [0, 3]]


def test_run_tree(spark, tmp_path):
    for a, d, m in (("full", "x", {"task": "prediction", "mae": 1.5}), ("bare", "x", {"task": "prediction", "mae": 2.5}), ("full", "y", {"accuracy": 0.5})):
        (tmp_path / a / d).mkdir(parents=True)
        (tmp_path / a / d / "metrics.json").write_text(json.dumps(m, indent=1))
    (tmp_path / "bare" / "y").mkdir()
    (tmp_path / "bare" / "y" / "metrics.json").write_text("{")
    runs = read_metrics(spark, str(tmp_path))
    assert {(r["dataset"], r["task"]) for r in task_of_dataset(runs).collect()} == {("x", "prediction"), ("y", "classification")}
    flat = runs.select("ablation", "dataset", F.try_variant_get("metrics", "$.mae", "double").alias("mae"), F.try_variant_get("metrics", "$.accuracy", "double").alias("accuracy"))
    wide = summary(long_metrics(flat, ["ablation", "dataset"], ["mae", "accuracy"]), [("x", "mae"), ("y", "accuracy")])
    assert [tuple(r) for r in wide.collect()] == [("bare", 2.5, None), ("full", 1.5, 0.5)]
    side = spark.createDataFrame([("full", "x", 9.0, 0.7)], "ablation string, dataset string, mae double, rate double")
    got = {(r["ablation"], r["dataset"]): (r["mae"], r["rate"]) for r in with_sidecar(flat, side, ["ablation", "dataset"], ["mae", "rate"]).collect()}
    assert got["full", "x"] == (1.5, 0.7) and got["bare", "x"] == (2.5, None)


def test_scoring(spark):
    rows = [(f"i{k}", None if k == 7 else "A") for k in range(20)]
    df = spark.createDataFrame(rows, "id string, answer string").coalesce(1)
    got = {r["id"]: r for r in score_rows(df, lambda: EchoScorer(largest=2), batch_size=8).collect()}
    assert len(got) == 20 and [k for k, r in got.items() if r["failed"]] == ["i7"] and got["i3"]["raw"] == "the answer is A" and "no answer" in got["i7"]["error"]
    assert [x[3] for x in score_batch(EchoScorer(), [{"id": "a", "answer": None}, {"id": "b", "answer": "B"}])] == [True, True]

    def call(row):
        if row["answer"] is None:
            raise ValueError("bad")
        return row["answer"]

    assert sum(r["failed"] for r in score_calls(df, call, 4).collect()) == 1
    tries, waits = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError
        return "ok"

    assert with_retry(flaky, sleep=waits.append) == "ok" and len(waits) == 2 and 1 <= waits[0] <= 1.5 and 2 <= waits[1] <= 2.5
    with pytest.raises(ValueError):
        with_retry(lambda: (_ for _ in ()).throw(ValueError()), sleep=waits.append)
    assert backend("echo", largest=3).largest == 3
    with pytest.raises(KeyError):
        backend("none")


def test_streamed_scoring_writes_each_row_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id":"a","answer":"A"}\n{"id":"b","answer":"B"}\n')
    score = lambda df: score_rows(df, EchoScorer)
    for name in ("2", "3"):
        q = score_stream(spark, src, "id string, answer string", score, out, mark)
        q.awaitTermination(60)
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps({"id": "c" + name, "answer": "C"}) + "\n")
    assert sorted(r["id"] for r in spark.read.json(out).collect()) == ["a", "b", "c2"]


def test_padding_and_targets_take_the_channels_of_telemetry(spark, tmp_path):
    import datetime as dt

    from brookmill.plans.prepare_queries import _clip_channels, series_pad_clips, single_target_clips

    at = [dt.datetime(2020, 1, 1, 0, 0, k) for k in range(3)]
    rows = [(1, "v", "a", at[0], 1.0, None), (2, "v", "a", at[1], float("nan"), 5.0), (3, "v", "a", at[0], 1.0, None), (4, "v", "b", at[2], 2.0, 6.0), (5, "v", "a", at[2], 3.0, 7.0)]
    spark.createDataFrame(rows, "reading_id bigint, vehicle_id string, timeseries_path string, timestamp timestamp, vEgo double, aEgo double").write.parquet(f"{tmp_path}/telemetry.parquet")
    d = str(tmp_path)
    assert {tuple(r)[1:] for r in series_pad_clips(spark, d).collect()} == {("a", 0, 3, 2, 3, 2, 0), ("a", 1, 3, 2, 3, 2, 0), ("b", 0, 1, 2, 3, 1, 2), ("b", 1, 1, 2, 3, 1, 2)}
    assert {tuple(r) for r in single_target_clips(spark, d).collect()} == {("a", 3, 2, 3.0), ("b", 1, 1, 2.0)}
    with pytest.raises(Exception, match="one channel"):
        single_channel(_clip_channels(spark, d), ["timeseries_path"]).collect()
