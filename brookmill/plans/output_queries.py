"""Registered queries of what is written: reports and tables, files that are written and read back, conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.functions.forecast import reply_text as reply, step_text
from brookmill.operators import classification as C
from brookmill.operators import normalize as N
from brookmill.operators.batching import plan_remaining
from brookmill.operators.regression import channel_scores, dataset_scores, score_rows
from brookmill.plans import prepare_queries as P
from brookmill.plans import score_queries as S
from brookmill.plans.prepare_queries import _clip_channels, _lengths
from brookmill.session import SharedFolder, table
from brookmill.sources import outputs as O
from brookmill.sources import runs as R
from brookmill.sources.manifest import first_lines, numbered_lines, read_predictions, read_samples, sample_lines, write_json_atomically, write_samples
from brookmill.sources.series import export_series, read_series, series_csv, write_series

BY = ["run_name"]


def _lines(df: DataFrame, by: list[str], text: str = "report") -> DataFrame:
    return df.select(*by, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def _scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, labels = S._labelled(spark, d)
    matrix = C.confusion(rows, labels, BY)
    report = C.class_report(matrix, BY)
    return C.overall(rows, report, labels, BY), report, matrix


def class_text(spark: SparkSession, d: str) -> DataFrame:
    return _lines(O.class_text(*_scores(spark, d), BY), BY)


def forecast_text(spark: SparkSession, d: str) -> DataFrame:
    rows = score_rows(S._forecasts(spark, d))
    return _lines(O.forecast_text_report(dataset_scores(rows, BY), channel_scores(rows, BY), BY), BY)


def compare_table(spark: SparkSession, d: str) -> DataFrame:
    df = S.compare_runs(spark, d)
    return O.aligned(df, df.columns, BY)


def metric_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their runs' counts, written by run and read back; a few of their values."""
    docs = O.class_documents(*_scores(spark, d), BY)
    counts = C.inference_rollup(table(spark, d, "predictions"), BY).withColumnRenamed("n_failed", "failed")
    runs = R.metrics_json(counts.select(*BY, "total", "succeeded", "failed", "success_rate"), BY)
    root = SharedFolder(spark, "metrics").path
    O.write_documents(O.with_run(docs, runs, BY), root, BY)
    v = F.try_parse_json("value")
    get = lambda k, t="bigint": F.try_variant_get(v, f"$.{k}", t)
    labels = F.try_variant_get(v, "$.labels", "array<string>")
    none = F.aggregate(F.transform(labels, lambda x: F.try_element_at(F.try_variant_get(v, "$.confusion_matrix", "map<string,map<string,bigint>>"), x)["None"]), F.lit(0).cast("bigint"), lambda a, b: a + b)
    read = spark.read.text(f"{root}/metrics").select(F.col("run_name").cast("string").alias("run_name"), "value")
    return read.select(*BY, get("total").alias("total"), F.size(labels).alias("n_labels"), none.alias("n_none"), get("infer.total").alias("n_run"), get("failed").alias("n_failed"), F.round(get("macro_f1", "double"), 6).alias("macro_f1"))


def summary_file(spark: SparkSession, d: str) -> DataFrame:
    path = SharedFolder(spark, "summary").path
    wide = S.summary_pivot(spark, d)
    O.write_csv(wide, path)
    return spark.read.option("header", True).schema(wide.schema).csv(path)


def default_columns(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "manifest").where("source is not null").groupBy(F.col("source").alias("dataset")).agg(F.min("task").alias("task"))
    return R.default_metrics(runs)


def run_sidecar(spark: SparkSession, d: str) -> DataFrame:
    path = SharedFolder(spark, "predictions").path
    O.write_predictions(table(spark, d, "predictions").drop("run_name"), path, {"task": "classification", "adapter": None})
    side = spark.read.json(f"{path}.metrics")
    return side.select("task", "total", "succeeded", "failed", F.round("success_rate", 6).alias("success_rate"), F.lit(read_predictions(spark, path).count()).alias("n_rows"))


def debug_rows(spark: SparkSession, d: str) -> DataFrame:
    path = SharedFolder(spark, "debug").path
    rows = S.forecast_metrics_row(spark, d)
    O.write_debug_rows(rows, path)
    return spark.read.schema(rows.schema).json(path)


def samples_again(spark: SparkSession, d: str) -> DataFrame:
    """The manifest as JSON lines with its undeclared fields, written, read and written over itself, and read again."""
    path = SharedFolder(spark, "samples").path
    m = table(spark, d, "manifest")
    rest = F.to_json(F.struct("row_no", "source", "split"))
    write_samples(m.drop("extra").withColumn("extra", rest), path, ["row_no"])
    write_samples(read_samples(spark, path), path)
    v = F.try_parse_json("extra")
    return read_samples(spark, path).select(
        F.try_variant_get(v, "$.row_no", "bigint").alias("row_no"), F.try_variant_get(v, "$.source", "string").alias("source"), "id", "task", "prompt", F.concat_ws("|", "image_path").alias("images"),
        "video_meta.nb_frames", F.concat_ws(",", F.transform("ts_shape", lambda x: x.cast("string"))).alias("shape"), "channel_index")


def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    path = SharedFolder(spark, "lines").path
    table(spark, d, "events").select(F.col("event_id").cast("string").alias("value")).coalesce(1).sortWithinPartitions(F.col("value").cast("bigint")).write.text(path)
    return first_lines(numbered_lines(spark, path), 5000).select(F.col("value").cast("bigint").alias("event_id"), "line_no")


def finished_rows(spark: SparkSession, d: str) -> DataFrame:
    """Results written in two chunks, one of them twice, and those that came before them."""
    from brookmill.sources.manifest import append_once

    path = SharedFolder(spark, "chunks").path
    p = table(spark, d, "predictions")
    first, second = p.where("not coalesce(failed, false)"), p.where("coalesce(failed, false)")
    for chunk, rows in (("0", first), ("1", second), ("1", second)):
        append_once(rows, path, chunk)
    return spark.read.schema(p.schema).json(path).groupBy("run_name").agg(F.count("*").alias("n"), F.count_if("failed").alias("n_failed"))


def remaining_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = _lengths(spark, d).join(table(spark, d, "manifest").select("row_no", "id"), "row_no")
    plan = plan_remaining(rows, table(spark, d, "predictions"), "id", "row_no", "n", "task", 40000, max_bs=32)
    padded = plan.groupBy("task", "bucket", "batch").agg(F.count("*").alias("k"), F.max("len").alias("most"))
    over = padded.where((F.col("k") > 1) & (F.col("k") * F.col("most") > 40000) | (F.col("k") > 32))
    return plan.groupBy("task").agg(F.count("*").alias("n"), F.sum("len").alias("total")).join(over.groupBy(F.col("task").alias("_t")).agg(F.count("*").alias("n_over")), F.col("task").eqNullSafe(F.col("_t")), "left").select("task", "n", "total", F.coalesce("n_over", F.lit(0)).alias("n_over"))


def _user_rows(spark: SparkSession, d: str) -> DataFrame:
    """A sample per user: the daily counts of two event types as its answer; every third one is a classification."""
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    daily = e.groupBy("user_id", "day").agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "click").alias("b"))
    line = F.concat(F.lit("("), F.col("day"), F.lit(": "), F.concat_ws(", ", F.col("a").cast("string"), F.col("b").cast("string")), F.lit(")"))
    text = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    rows = daily.groupBy("user_id").agg(text.alias("t"), F.count("*").alias("steps"))
    fc = F.col("user_id") % 3 != 0
    return rows.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.when(fc, "prediction").when(F.col("user_id") % 2 == 0, "classification").alias("task"), F.when(fc, F.concat(F.lit("<forecast>\n"), "t", F.lit("\n</forecast>"))).otherwise("A").alias("answer"),
        F.lit("v.mp4").alias("video_path"), F.array(F.lit("view"), F.lit("click")).alias("names"), "steps")


def channel_rows(spark: SparkSession, d: str) -> DataFrame:
    out = N.per_channel_rows(_user_rows(spark, d), "names", "steps", "s/")
    return out.select("id", "task", "answer", "video_path", "timeseries_path", "forecast_target_path", F.col("ts_shape")[0].alias("steps"), "channel_index", "channel_name")


def channel_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _user_rows(spark, d)
    return spark.createDataFrame([N.conversion_counts(rows, N.per_channel_rows(rows, "names", "steps"))], "n_in bigint, n_out bigint")


def channel_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets written as one table and read back."""
    path = SharedFolder(spark, "targets").path
    write_series(N.channel_targets(_user_rows(spark, d), "names"), path, "id")
    return spark.read.parquet(path).select("id", "step", "channel", "value")


def series_files(spark: SparkSession, d: str) -> DataFrame:
    """Every clip's series as a file of its own, read back; the files lie where the executors' file system has them."""
    folder = SharedFolder(spark, "files").path.removeprefix("file://")
    long = _clip_channels(spark, d)
    made = export_series(long, folder, "timeseries_path")
    read = read_series(spark, folder).groupBy("path").agg(F.countDistinct("step").alias("n_steps"), F.countDistinct("channel_index").alias("n_channels"), F.count("value").alias("n_known"))
    return read.withColumn("path", F.regexp_replace("path", "^file:/*", "/")).join(made, "path").select(F.col("key").alias("timeseries_path"), "n_steps", "n_channels", "n_known")


def series_texts(spark: SparkSession, d: str) -> DataFrame:
    text = series_csv(_clip_channels(spark, d), ["timeseries_path"])
    return text.select("timeseries_path", F.substring_index("csv", "\n", 1).alias("head"), (F.size(F.split("csv", "\n")) - 2).alias("n_steps"))


def step_labels(spark: SparkSession, d: str) -> DataFrame:
    values = F.transform(F.sequence(F.lit(1), (F.col("p_size") % 5 + 1).cast("int")), lambda i: i * F.lit(0.5) + F.col("p_partkey") % 7)
    return table(spark, d, "part").select("p_partkey", step_text(values).alias("text"))


def reply_text(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("event_id") % 4, F.col("event_type")
    body = (
        F.when(k == 0, F.concat(F.lit('{"output_text": "'), t, F.lit('"}'))).when(k == 1, F.concat(F.lit('{"output_text": "", "output": [{"content": null}, {"content": [{"text": ""}, {"text": "'), t, F.lit('"}]}]}')))
        .when(k == 2, F.lit('{"output": [{"content": [{"kind": "x"}]}]}')).otherwise("{"))
    return table(spark, d, "events").select("event_id", reply(body).alias("text"))


def sample_objects(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").select("row_no", "id", F.lit(None).cast("string").alias("task"), F.when(F.col("row_no") % 2 == 0, '{"a": [1, null]}').alias("extra"))
    line = sample_lines(m.select("id", "task", "extra"), ["id"])
    return line.groupBy("value").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    class_text, forecast_text, compare_table, metric_documents, summary_file, default_columns, run_sidecar, debug_rows, samples_again, line_numbers, finished_rows, remaining_batches,
    channel_rows, channel_counts, channel_targets, series_files, series_texts, step_labels, reply_text, sample_objects)}

_USERS = """
    daily as (select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) filter (event_type = 'view') as a, count(*) filter (event_type = 'click') as b from events group by all),
    users as (select user_id, 'u' || user_id as id, case when user_id % 3 <> 0 then 'prediction' when user_id % 2 = 0 then 'classification' end as task, count(*) as steps,
      '<forecast>' || chr(10) || string_agg('(' || day || ': ' || a || ')', chr(10) order by day) || chr(10) || '</forecast>' as ta,
      '<forecast>' || chr(10) || string_agg('(' || day || ': ' || b || ')', chr(10) order by day) || chr(10) || '</forecast>' as tb from daily group by user_id)"""

SQL = {
    "class_text": f"""
        with {S._REPORT}, {S._OVERALL.split(S._REPORT + ",")[1]},
        flat as (
          select run_name, 0 as k, '' as l, format('n={{}}  correct={{}}  unparseable={{}}  unknown_gt={{}}', total, correct, unparseable, unknown_gt) as line from base
          union all select run_name, 1, '', format('Accuracy    : {{:.4f}}', correct::double / greatest(1, total)) from base
          union all select run_name, 2, '', format('Macro F1    : {{:.4f}}', m.macro_f1) from means m
          union all select run_name, 3, '', format('Weighted F1 : {{:.4f}}', m.weighted_f1) from means m
          union all select run_name, 4, '', format('UAR         : {{:.4f}}  (= macro-averaged recall)', m.uar) from means m
          union all select run_name, 5, '', '' from base
          union all select run_name, 6, '', '   class  precision     recall         f1    support' from base
          union all select run_name, 7, label, format('{{:>8}} {{:>10.4f}} {{:>10.4f}} {{:>10.4f}} {{:>10}}', label, p::double, r::double, f::double, support::bigint) from report
          union all select run_name, 8, '', '' from base
          union all select run_name, 9, '', 'Confusion matrix (rows=gt, cols=pred; trailing col = unparseable):' from base
          union all select run_name, 10, '', '   gt/pred' || (select string_agg(lpad(l, greatest(7, length(l))::int, ' '), '' order by l) from labels) || '   None' from base
          union all select run_name, 11, gt, lpad(gt, greatest(10, length(gt))::int, ' ') || string_agg(format('{{:>7}}', n), '' order by pred is null, pred) from cells group by run_name, gt)
        select run_name, (row_number() over (partition by run_name order by k, l) - 1)::int as pos, line from flat""",
    "compare_table": "with x as (" + S.SQL["compare_runs"] + """),
        head as (select 0::bigint as line_no, array_to_string(list_transform(['run_name', 'n', 'overall', 'acc_A', 'acc_B', 'acc_C', 'pred_A', 'pred_B', 'pred_C', 'pred_None'], lambda c: rpad(c, 11, ' ')), '  ') as line),
        body as (select row_number() over (order by run_name) as line_no, array_to_string(list_transform([run_name, n::varchar, coalesce(format('{:.4f}', overall), 'None'), coalesce(format('{:.4f}', "acc_A"), 'None'),
          coalesce(format('{:.4f}', "acc_B"), 'None'), coalesce(format('{:.4f}', "acc_C"), 'None'), "pred_A"::varchar, "pred_B"::varchar, "pred_C"::varchar, "pred_None"::varchar], lambda c: rpad(c, greatest(11, length(c))::int, ' ')), '  ') as line from x)
        select * from head union all select * from body""",
    "metric_documents": f"""with {S._OVERALL}, none as (select run_name, sum(n)::bigint as n_none from cells where pred is null group by all),
        runs as (select run_name, count(*) as n_run, count(*) filter (coalesce(failed, false)) as n_failed from predictions group by all)
        select run_name, total, (select count(*) from labels)::int as n_labels, n_none, n_run, n_failed, macro_f1 from overall join none using (run_name) join runs using (run_name)""",
    "summary_file": S.SQL["summary_pivot"],
    "default_columns": """with d as (select source as dataset, case when min(task) = 'prediction' then 'prediction' else 'classification' end as task from manifest where source is not null group by source)
        select dataset, task, unnest(case when task = 'prediction' then ['mae', 'mse', 'mape', 'pcc', 'success_rate'] else ['accuracy', 'macro_f1', 'weighted_f1', 'success_rate'] end) as metric,
          unnest(case when task = 'prediction' then [0, 1, 2, 3, 4] else [0, 1, 2, 3] end)::int as pos from d""",
    "run_sidecar": """select 'classification' as task, count(*) as total, count(*) filter (not coalesce(failed, false)) as succeeded, count(*) filter (coalesce(failed, false)) as failed,
        round(count(*) filter (not coalesce(failed, false))::double / count(*), 6) as success_rate, count(*)::int as n_rows from predictions""",
    "debug_rows": S.SQL["forecast_metrics_row"],
    "samples_again": """select row_no, source, id, task, prompt, array_to_string(coalesce(image_path, []), '|') as images, video_meta.nb_frames as nb_frames,
        array_to_string(coalesce(list_transform(ts_shape, lambda x: x::varchar), []), ',') as shape, channel_index from manifest""",
    "line_numbers": "select event_id, line_no from (select event_id, row_number() over (order by event_id) as line_no from events) where line_no <= 5000",
    "finished_rows": "select run_name, count(*) as n, count(*) filter (failed) as n_failed from predictions group by all",
    "remaining_batches": f"""with {P._LENGTHS}, left_ as (select lengths.task, n from lengths join manifest m using (row_no) where not exists (select 1 from predictions p where p.id = m.id))
        select task, count(*) as n, sum(coalesce(n, 0))::bigint as total, 0::bigint as n_over from left_ group by all""",
    "channel_rows": f"""with {_USERS}
        select id || '__ch0' as id, task, ta as answer, 'v.mp4' as video_path, 's/' || id || '__ch0.csv' as timeseries_path, 's/' || id || '__ch0.target.csv' as forecast_target_path, steps::int as steps, 0 as channel_index, 'view' as channel_name from users where task = 'prediction'
        union all select id || '__ch1', task, tb, 'v.mp4', 's/' || id || '__ch1.csv', 's/' || id || '__ch1.target.csv', steps::int, 1, 'click' from users where task = 'prediction'
        union all select id, task, 'A', 'v.mp4', null, null, null, null, null from users where task is distinct from 'prediction'""",
    "channel_counts": f"with {_USERS} select count(*) as n_in, sum(case when task = 'prediction' then 2 else 1 end)::bigint as n_out from users",
    "channel_targets": """with daily as (select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) filter (event_type = 'view') as a, count(*) filter (event_type = 'click') as b from events where user_id % 3 <> 0 group by all),
        x as (select *, (row_number() over (partition by user_id order by day) - 1)::int as step from daily)
        select 'u' || user_id || '__ch0' as id, step, 'view' as channel, a::double as value from x union all select 'u' || user_id || '__ch1', step, 'click', b::double from x""",
    "series_files": """with o as (select timeseries_path, timestamp, min(reading_id) as reading_id from telemetry group by all),
        r as (select t.timeseries_path, unnest(["vEgo", "aEgo", "steeringAngleDeg", lead_speed_kmh, lead_a]) as v, t.reading_id from telemetry t join o using (reading_id))
        select timeseries_path, count(distinct reading_id) as n_steps, 5::bigint as n_channels, count(*) filter (v is not null and not isnan(v)) as n_known from r group by all""",
    "series_texts": """select timeseries_path, 'vEgo,aEgo,steeringAngleDeg,lead_speed_kmh,lead_a' as head, count(distinct timestamp)::int as n_steps from telemetry group by all""",
    "step_labels": """with x as (select p_partkey, unnest(range(1, p_size % 5 + 2)) as i from part)
        select p_partkey, '<forecast>' || chr(10) || string_agg('(' || (i - 1) || ': ' || printf('%g', i * 0.5 + p_partkey % 7) || ')', chr(10) order by i) || chr(10) || '</forecast>' as text from x group by all""",
    "reply_text": "select event_id, case when event_id % 4 <= 1 then event_type end as text from events",
    "sample_objects": """with x as (select case when id is null then '' else '"id":' || to_json(id) end as i, case when row_no % 2 = 0 then '"a": [1, null]' else '' end as e from manifest)
        select '{' || i || case when i <> '' and e <> '' then ',' else '' end || e || '}' as value, count(*) as n from x group by all""",
}
