"""Registered queries on predictions: labels, classification scores, forecasts and their errors, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.functions.forecast import forecast_block, forecast_text, parse_forecast
from brookmill.functions.labels import parse_label
from brookmill.operators import classification as C
from brookmill.operators.align import align_forecast
from brookmill.operators.regression import channel_scores, dataset_scores, score_rows
from brookmill.session import table
from brookmill.sources.runs import effective_rate, long_metrics, metrics_json, report_lines, summary

BY = ["run_name"]


def _r(c: str, digits: int = 6):  # noqa: ANN202
    return F.round(F.col(c).cast("double"), digits).alias(c)


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").where(~F.coalesce(F.col("ground_truth").contains("<forecast>"), F.lit(False)))


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    rows = _classes(spark, d)
    labels = C.label_set(rows)
    done = rows.where(~F.coalesce(F.col("failed"), F.lit(False)))
    return done.select("run_name", "id", "raw", "prediction", F.col("ground_truth").alias("gt"), parse_label(F.col("raw"), labels).alias("pred")), labels


def label_parse(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d)[0].select("run_name", "id", "gt", "raw", "pred")


def label_parse_strict(spark: SparkSession, d: str) -> DataFrame:
    rows, labels = _labelled(spark, d)
    return rows.select("run_name", "id", "raw", parse_label(F.col("raw"), labels, fallback=False).alias("pred"))


def cls_confusion(spark: SparkSession, d: str) -> DataFrame:
    rows, labels = _labelled(spark, d)
    return C.confusion(rows, labels, BY)


def cls_report(spark: SparkSession, d: str) -> DataFrame:
    rows, labels = _labelled(spark, d)
    return C.class_report(C.confusion(rows, labels, BY), BY).select(*BY, "label", "tp", "fp", "fn", "support", _r("precision"), _r("recall"), _r("f1"))


def cls_overall(spark: SparkSession, d: str) -> DataFrame:
    rows, labels = _labelled(spark, d)
    report = C.class_report(C.confusion(rows, labels, BY), BY)
    return C.overall(rows, report, labels, BY).select(*BY, "total", "correct", "unparseable", "unknown_gt", _r("accuracy"), _r("macro_f1"), _r("weighted_f1"), _r("uar"))


def cls_text_report(spark: SparkSession, d: str) -> DataFrame:
    return report_lines(cls_overall(spark, d), BY, ["accuracy", "macro_f1", "uar"])


def cls_metrics_json(spark: SparkSession, d: str) -> DataFrame:
    return metrics_json(cls_overall(spark, d).select("run_name", "total", "correct", "unparseable"), BY)


def per_option_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return C.per_option(_classes(spark, d).withColumnRenamed("ground_truth", "gt").withColumnRenamed("prediction", "pred"), BY)


def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    out = C.compare_runs(_classes(spark, d).withColumnRenamed("ground_truth", "gt").withColumnRenamed("prediction", "pred"), BY)
    return out.select(*BY, "n", _r("overall"), *(_r(f"acc_{o}") for o in "ABC"), *(f"pred_{o}" for o in "ABC"), "pred_None")


def infer_rollup(spark: SparkSession, d: str) -> DataFrame:
    return C.inference_rollup(table(spark, d, "predictions"), BY).select(*BY, "total", "succeeded", "n_failed", _r("success_rate"), _r("accuracy"), _r("accuracy_succeeded"))


def infer_distribution(spark: SparkSession, d: str) -> DataFrame:
    return C.distribution(_classes(spark, d), BY, "prediction")


def reparse_changes(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = _labelled(spark, d)
    return C.reparse_changes(rows, F.col("pred"), BY)


def task_detect(spark: SparkSession, d: str) -> DataFrame:
    return C.detect_task(table(spark, d, "manifest"), "row_no", ["source"])


def task_single(spark: SparkSession, d: str) -> DataFrame:
    return C.single_task(table(spark, d, "manifest"), ["source"])


def _forecasts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "predictions").where(F.col("ground_truth").contains("<forecast>"))
    truth, said = parse_forecast(F.col("ground_truth")), parse_forecast(F.coalesce("raw", "prediction"))
    return rows.withColumns({"truth": truth, "said": said}).withColumn("aligned", align_forecast(F.col("truth"), F.col("said")))


def forecast_parse(spark: SparkSession, d: str) -> DataFrame:
    return _forecasts(spark, d).select("run_name", "id", F.explode("said").alias("r")).select("run_name", "id", "r.pos", "r.label", F.size("r.values").alias("n_values"), F.round(F.aggregate("r.values", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def forecast_blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").select("run_name", "id", forecast_block(F.col("raw")).alias("block"))


def forecast_answer(spark: SparkSession, d: str) -> DataFrame:
    """Channel 0 of every parsed answer of the manifest, written anew."""
    rows = table(spark, d, "manifest").where(F.col("answer").contains("<forecast>"))
    return rows.select("row_no", forecast_text(parse_forecast(F.col("answer")), F.lit(0)).alias("answer"))


def forecast_align(spark: SparkSession, d: str) -> DataFrame:
    a = _forecasts(spark, d).where("aligned is not null")
    return a.select("run_name", "id", "aligned.alignment", "aligned.missing_labels", "aligned.length_mismatch", "aligned.len_gt", "aligned.len_pred")


def forecast_metrics_row(spark: SparkSession, d: str) -> DataFrame:
    s = score_rows(_forecasts(spark, d)).where("aligned is not null")
    return s.select("run_name", "id", "score.*").select("run_name", "id", "n", _r("mae"), _r("mse"), _r("mape"), "mape_skipped", _r("pcc"))


def forecast_metrics_dataset(spark: SparkSession, d: str) -> DataFrame:
    out = dataset_scores(score_rows(_forecasts(spark, d)), BY)
    return out.select(*BY, "total", "succeeded", "n_failed", _r("parse_rate"), "length_mismatch_count", "n_by_label", "n_positional", _r("mae"), _r("mse"), _r("mape"), "mape_skipped", _r("pcc"), "channels")


def forecast_metrics_channel(spark: SparkSession, d: str) -> DataFrame:
    return channel_scores(score_rows(_forecasts(spark, d)), BY).select(*BY, "channel", "n_rows", _r("mae"), _r("mse"), _r("mape"))


def summary_pivot(spark: SparkSession, d: str) -> DataFrame:
    cls = C.inference_rollup(_classes(spark, d), BY).withColumn("dataset", F.lit("classes"))
    fc = dataset_scores(score_rows(_forecasts(spark, d)), BY).join(
        C.inference_rollup(table(spark, d, "predictions").where(F.col("ground_truth").contains("<forecast>")), BY).select("run_name", F.col("success_rate").alias("s")), BY)
    fc = fc.withColumns({"dataset": F.lit("forecast"), "success_rate": effective_rate(F.lit("prediction"), F.col("s"), F.col("parse_rate"))})
    long = long_metrics(cls, ["run_name", "dataset"], ["accuracy", "success_rate"]).unionByName(long_metrics(fc, ["run_name", "dataset"], ["mae", "success_rate"]))
    wide = summary(long.withColumnRenamed("run_name", "ablation"), [("classes", "accuracy"), ("classes", "success_rate"), ("forecast", "mae"), ("forecast", "success_rate")])
    return wide.select("ablation", *(F.round(F.col(f"`{c}`"), 6).alias(c.replace("/", "_")) for c in wide.columns[1:]))


QUERIES = {f.__name__: f for f in (
    label_parse, label_parse_strict, cls_confusion, cls_report, cls_overall, cls_text_report, cls_metrics_json, per_option_accuracy, compare_runs, infer_rollup, infer_distribution, reparse_changes,
    task_detect, task_single, forecast_parse, forecast_blocks, forecast_answer, forecast_align, forecast_metrics_row, forecast_metrics_dataset, forecast_metrics_channel, summary_pivot)}

_LABELLED = """
    classes as (select * from predictions where not coalesce(contains(ground_truth, '<forecast>'), false)),
    labels as (select distinct ground_truth as l from classes where ground_truth is not null and not coalesce(failed, false)),
    strict as (
      select row_number() over () as k, run_name, id, raw, prediction, ground_truth as gt,
        nullif(regexp_extract(raw, '(?:^|[^A-Za-z])(' || (select string_agg(l, '|' order by length(l) desc, l) from labels) || ')(?:[^A-Za-z]|$)', 1, 'i'), '') as hit,
        nullif(regexp_extract(ltrim(raw, chr(10) || chr(13) || chr(9) || ' '), '^([A-Za-z]+|[0-9]+)', 1), '') as head
      from classes where not coalesce(failed, false)),
    heads as (select k, arg_max(l, length(l)) as l from strict join labels on starts_with(lower(head), lower(l)) group by k),
    spelled as (select k, any_value(l) as l from strict join labels on lower(hit) = lower(l) group by k),
    parsed as (select run_name, id, raw, prediction, gt, coalesce(spelled.l, heads.l) as pred, spelled.l as strict_pred from strict left join spelled using (k) left join heads using (k))"""
_MATRIX = _LABELLED + """,
    grid as (select r.run_name, a.l as gt, b.l as pred from (select distinct run_name from parsed) r, labels a, (select l from labels union all select null) b),
    cells as (
      select g.run_name, g.gt, g.pred, count(p.gt) as n from grid g left join parsed p
        on p.run_name = g.run_name and p.gt = g.gt and (case when p.pred in (select l from labels) then p.pred end) is not distinct from g.pred
      group by all)"""
_REPORT = _MATRIX + """,
    per as (
      select run_name, gt as label, sum(case when gt = pred then n else 0 end) as tp, sum(n) as support from cells group by all),
    guessed as (select run_name, pred as label, sum(n) as guessed from cells where pred is not null group by all),
    ratios as (
      select *, case when guessed > 0 then tp::double / guessed else 0 end as p, case when support > 0 then tp::double / support else 0 end as r
      from per join guessed using (run_name, label)),
    report as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f from ratios)"""
_OVERALL = _REPORT + """,
    base as (
      select run_name, count(*) as total, count(*) filter (gt = pred and gt in (select l from labels)) as correct,
        count(*) filter (pred is null and gt in (select l from labels)) as unparseable,
        count(*) filter (not coalesce(gt in (select l from labels), false)) as unknown_gt from parsed group by all),
    means as (
      select run_name, sum(f) / greatest(1, count(*)) as macro_f1, case when sum(support) > 0 then sum(f * support) / sum(support) else 0 end as weighted_f1,
        sum(r) / greatest(1, count(*)) as uar from report group by all),
    overall as (
      select run_name, total, correct, unparseable, unknown_gt, round(correct::double / greatest(1, total), 6) as accuracy,
        round(macro_f1, 6) as macro_f1, round(weighted_f1, 6) as weighted_f1, round(uar, 6) as uar from base join means using (run_name))"""


def _parse(source: str, text: str, name: str) -> str:
    """CTEs that parse forecasts: {name} has k, pos, label, vals."""
    return f"""
    {name}_body as (select k, case when regexp_matches({text}, '<forecast>', 'i') then regexp_extract({text}, '<forecast>(.*?)(?:</forecast>|\\z)', 1, 'is') else {text} end as b from {source}),
    {name}_inner as (select k, unnest(regexp_extract_all(b, '\\(([^()\\n]+)\\)', 1)) as x, generate_subscripts(regexp_extract_all(b, '\\(([^()\\n]+)\\)', 1), 1) as i from {name}_body),
    {name}_cut as (
      select k, i, trim(x) as x, case when contains(x, ':') then regexp_extract(trim(x), ':([^:]*)$', 1) when contains(x, ',') then regexp_extract(trim(x), '^[^,]*,(.*)$', 1) end as v,
        case when contains(x, ':') then trim(regexp_extract(trim(x), '^(.*):[^:]*$', 1)) else trim(regexp_extract(trim(x), '^([^,]*),', 1)) end as label from {name}_inner),
    {name}_num as (
      select k, i, label, list_transform(regexp_extract_all(regexp_replace(v, '\\b[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}\\b', '', 'g'), '-?[0-9]+(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?'), lambda t: t::double) as vals
      from {name}_cut where v is not null),
    {name} as (select k, row_number() over (partition by k order by i) - 1 as pos, label, vals from {name}_num where len(vals) > 0)"""


_FORECASTS = """
    fc as (select row_number() over () as k, run_name, id, ground_truth, coalesce(raw, prediction) as said, failed from predictions where contains(ground_truth, '<forecast>')),""" + _parse("fc", "ground_truth", "g") + "," + _parse("fc", "said", "p")
_ALIGNED = _FORECASTS + """,
    last as (select k, label, arg_max(vals, pos) as vals from p group by all),
    sizes as (
      select g.k, count(*) as len_gt, max(len(g.vals)) as width, count(*) filter (last.label is null) as missing_labels from g left join last on g.k = last.k and g.label = last.label group by all),
    said as (select k, count(*) as len_pred from p group by all),
    al as (select s.*, len_pred, missing_labels = 0 as by_label, len_gt <> len_pred as length_mismatch from sizes s join said using (k)),
    rows as (
      select g.k, g.pos, g.vals as gv, last.vals as pv from g join al using (k) join last on g.k = last.k and g.label = last.label where by_label
      union all select g.k, g.pos, g.vals, p.vals from g join al using (k) join p on g.k = p.k and g.pos = p.pos where not by_label),
    pairs as (
      select k, c - 1 as channel, gv[c] as g, pv[c] as p from (select r.k, r.gv, r.pv, unnest(range(1, al.width + 1)) as c from rows r join al using (k))
      where gv[c] is not null and pv[c] is not null and isfinite(gv[c]) and isfinite(pv[c])),
    chan as (
      select k, channel, count(*) as n, avg(abs(g - p)) as mae, avg((g - p) * (g - p)) as mse, avg(case when abs(g) >= 1e-8 then abs(g - p) / abs(g) end) * 100 as mape,
        case when count(*) >= 2 and min(g) < max(g) and min(p) < max(p) then corr(g, p) end as pcc from pairs group by all),
    per as (
      select al.k, count(pairs.g) as n, avg(abs(g - p)) as mae, avg((g - p) * (g - p)) as mse, avg(case when abs(g) >= 1e-8 then abs(g - p) / abs(g) end) * 100 as mape,
        count(*) filter (abs(g) < 1e-8) as mape_skipped from al left join pairs using (k) group by all),
    scored as (select per.*, q.pcc from per left join (select k, avg(pcc) as pcc from chan group by all) q using (k))"""
_DATASET = _ALIGNED + """,
    dataset as (
      select run_name, count(*) as total, count(al.k) as succeeded, count(*) - count(al.k) as n_failed, count(al.k)::double / count(*) as parse_rate,
        count(*) filter (length_mismatch) as length_mismatch_count, count(*) filter (by_label) as n_by_label, count(*) filter (not by_label) as n_positional,
        avg(mae) as mae, avg(mse) as mse, avg(mape) as mape, coalesce(sum(mape_skipped), 0)::bigint as mape_skipped, avg(pcc) as pcc, max(width) as channels
      from fc left join al using (k) left join scored using (k) group by all)"""

SQL = {
    "label_parse": f"with {_LABELLED} select run_name, id, gt, raw, pred from parsed",
    "label_parse_strict": f"with {_LABELLED} select run_name, id, raw, strict_pred as pred from parsed",
    "cls_confusion": f"with {_MATRIX} select run_name, gt, pred, n from cells",
    "cls_report": f"""with {_REPORT} select run_name, label, tp::bigint as tp, (guessed - tp)::bigint as fp, (support - tp)::bigint as fn, support::bigint as support,
        round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1 from report""",
    "cls_overall": f"with {_OVERALL} select * from overall",
    "cls_text_report": f"with {_OVERALL} select run_name, printf('accuracy: %.4f', accuracy) || chr(10) || printf('macro_f1: %.4f', macro_f1) || chr(10) || printf('uar: %.4f', uar) as report from overall",
    "cls_metrics_json": f"""with {_OVERALL} select run_name, printf('{{"total":%d,"correct":%d,"unparseable":%d}}', total, correct, unparseable) as json from overall""",
    "per_option_accuracy": """select run_name, ground_truth as gt, count(*) filter (ground_truth is not distinct from prediction) as correct, count(*) as total
        from predictions where not coalesce(contains(ground_truth, '<forecast>'), false) group by all""",
    "compare_runs": """select run_name, count(*) as n, round(avg((ground_truth is not distinct from prediction)::int), 6) as overall,
        """ + ", ".join(f"round(avg((prediction is not distinct from '{o}')::int) filter (ground_truth = '{o}'), 6) as \"acc_{o}\", count(*) filter (prediction = '{o}') as \"pred_{o}\"" for o in "ABC") + """,
        count(*) filter (prediction is null) as "pred_None" from predictions where not coalesce(contains(ground_truth, '<forecast>'), false) group by all""",
    "infer_rollup": """select run_name, count(*) as total, count(*) filter (not coalesce(failed, false)) as succeeded, count(*) filter (coalesce(failed, false)) as n_failed,
        round(count(*) filter (not coalesce(failed, false))::double / count(*), 6) as success_rate,
        round(count(*) filter (not coalesce(failed, false) and ground_truth = prediction)::double / count(*), 6) as accuracy,
        round(coalesce(count(*) filter (not coalesce(failed, false) and ground_truth = prediction)::double / nullif(count(*) filter (not coalesce(failed, false)), 0), 0), 6) as accuracy_succeeded
        from predictions group by all""",
    "infer_distribution": """select run_name, case when coalesce(failed, false) then '_FAILED_' when coalesce(prediction, '') = '' then '_NONE_' else prediction end as bucket, count(*) as n
        from predictions where not coalesce(contains(ground_truth, '<forecast>'), false) group by all""",
    "reparse_changes": f"with {_LABELLED} select run_name, count(*) as n, count(*) filter (pred is distinct from prediction) as n_changed from parsed group by all",
    "task_detect": """select source, coalesce((arg_min(coalesce(nullif(task, ''), '?'), row_no)), '?') as first, coalesce(nullif(coalesce(arg_min(coalesce(nullif(task, ''), '?'), row_no), '?'), '?'),
        arg_min(task, row_no) filter (nullif(task, '') is not null), 'classification') as task from manifest group by all""",
    "task_single": "select source, case when count(distinct nullif(task, '')) = 1 then min(nullif(task, '')) else 'classification' end as task from manifest group by all",
    "forecast_parse": f"with {_FORECASTS} select run_name, id, pos::int as pos, label, len(vals)::int as n_values, round(list_sum(vals), 6) as total from p join fc using (k)",
    "forecast_blocks": """select run_name, id, case when regexp_matches(raw, '<forecast>', 'i')
        then '<forecast>' || rtrim(regexp_extract(raw, '<forecast>(.*?)(?:</forecast>|\\z)', 1, 'is'), ' ' || chr(10) || chr(13) || chr(9)) || chr(10) || '</forecast>' end as block from predictions""",
    "forecast_answer": "with src as (select row_no as k, answer from manifest where contains(answer, '<forecast>'))," + _parse("src", "answer", "a") + """
        select k as row_no, '<forecast>' || chr(10) || string_agg('(' || label || ': ' || printf('%g', vals[1]) || ')', chr(10) order by pos) || chr(10) || '</forecast>' as answer from a group by k""",
    "forecast_align": f"""with {_ALIGNED} select run_name, id, case when by_label then 'by_label' else 'positional' end as alignment, missing_labels::int as missing_labels, length_mismatch,
        len_gt::int as len_gt, len_pred::int as len_pred from al join fc using (k)""",
    "forecast_metrics_row": f"""with {_ALIGNED} select run_name, id, n::int as n, round(mae, 6) as mae, round(mse, 6) as mse, round(mape, 6) as mape, mape_skipped::int as mape_skipped, round(pcc, 6) as pcc
        from scored join fc using (k)""",
    "forecast_metrics_dataset": f"""with {_DATASET} select run_name, total, succeeded, n_failed, round(parse_rate, 6) as parse_rate, length_mismatch_count, n_by_label, n_positional, round(mae, 6) as mae,
        round(mse, 6) as mse, round(mape, 6) as mape, mape_skipped, round(pcc, 6) as pcc, channels::int as channels from dataset""",
    "forecast_metrics_channel": f"""with {_ALIGNED}, every as (select k, unnest(range(0, width)) as channel from al)
        select run_name, channel::int as channel, count(n) as n_rows, round(avg(mae), 6) as mae, round(avg(mse), 6) as mse, round(avg(mape), 6) as mape
        from every left join chan using (k, channel) join fc using (k) group by run_name, channel""",
    "summary_pivot": f"""with {_DATASET},
        rates as (select run_name, contains(ground_truth, '<forecast>') as is_fc, avg((not coalesce(failed, false))::int) as ok, avg((not coalesce(failed, false) and coalesce(ground_truth = prediction, false))::int) as acc from predictions group by all)
        select a.run_name as ablation, round(a.acc, 6) as classes_accuracy, round(a.ok, 6) as classes_success_rate, round(mae, 6) as forecast_mae, round(b.ok * parse_rate, 6) as forecast_success_rate
        from rates a join rates b using (run_name) join dataset using (run_name) where not a.is_fc and b.is_fc""",
}
SQL["task_detect"] = "select source, task from (" + SQL["task_detect"] + ")"
