"""Registered queries that prepare data: ingest, normalisation, lengths, batches, conversations and layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brookmill.functions.forecast import parse_forecast
from brookmill.functions.tsblock import linspace_picks, parse_block, strip_block, thin_block
from brookmill.operators import annotate as A
from brookmill.operators import conversation as V
from brookmill.operators import layout as L
from brookmill.operators import normalize as N
from brookmill.operators.batching import plan_batches, plan_steps, shard
from brookmill.operators.lengths import image_tokens, length_summary, sampled_frames, sequence_length, series_tokens, video_tokens
from brookmill.operators.lengths import LengthConfig
from brookmill.operators.ordinals import ordinals
from brookmill.operators.scoring import EchoScorer, score_rows
from brookmill.session import table
from brookmill.sources.manifest import safe_name, typed_samples
from brookmill.sources.series import clip_times, complete_video_meta, frame_count, midpoints, pad_series, series_shape, single_channel

_M = "manifest"


def _event_json():  # noqa: ANN202
    e = F.col("event_id")
    extra = (
        F.when(e % 4 == 0, F.concat(F.lit(', "video_id": "v'), e.cast("string"), F.lit('"'))).when(e % 4 == 1, F.concat(F.lit(', "id": "i'), e.cast("string"), F.lit('", "task": null')))
        .when(e % 4 == 2, F.concat(F.lit(', "id": "old", "video_id": "v'), e.cast("string"), F.lit('", "task": "prediction"'))).otherwise(F.lit(""))
    )
    return F.concat(F.substring_index("props", "}", 1), extra, F.lit("}"))


def normalize_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "event_type", _event_json().alias("line"))
    return N.normalize_rows(rows, "line").select("event_id", "id", "task", "renamed", "task_added")


def normalize_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", _event_json().alias("line"))
    return N.change_counts(N.normalize_rows(rows, "line"), ["event_type"])


def image_paths(spark: SparkSession, d: str) -> DataFrame:
    """Image fields written as one text, a list or null, made lists."""
    m = table(spark, d, _M).select("row_no", "image_path")
    value = F.when(F.size("image_path") == 1, F.concat(F.lit('{"image_path": "'), F.col("image_path")[0], F.lit('"}'))).when(F.size("image_path") > 1, F.to_json(F.struct("image_path"))).otherwise('{"image_path": null}')
    out = m.select("row_no", value.alias("value"))
    return typed_samples(out).select("row_no", F.concat_ws("|", "image_path").alias("paths"), F.size("image_path").alias("n"))


def multi_source_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return N.union_sources({"customer": c, "supplier": s}).select("source_id", "source_name", "key", "name", "segment")


def short_clip_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _M).where(N.long_enough(F.col("video_meta"), 120)).select("row_no", "source")


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return N.source_counts(table(spark, d, _M), N.long_enough(F.col("video_meta"), 120), ["source"])


def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    return N.resume(table(spark, d, _M).select("row_no", "id"), table(spark, d, "predictions"), "id")


def resume_retry(spark: SparkSession, d: str) -> DataFrame:
    return N.resume(table(spark, d, _M).select("row_no", "id"), table(spark, d, "predictions"), "id", retry_failed=True)


def strip_prompt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _M).select("row_no", strip_block(F.col("prompt")).alias("prompt"))


def block_values(spark: SparkSession, d: str) -> DataFrame:
    return parse_block(table(spark, d, _M), ["row_no"], "prompt")


def thin_prompt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _M).select("row_no", thin_block(F.col("prompt"), 3, 1).alias("prompt"))


def picks(spark: SparkSession, d: str) -> DataFrame:
    n, m = (F.col("p_partkey") % 97 + 2).cast("int"), (F.col("p_size") % 12 + 1).cast("int")
    return table(spark, d, "part").select("p_partkey", F.explode(linspace_picks(n, m)).alias("pick"))


def explode_channels(spark: SparkSession, d: str) -> DataFrame:
    """Event counts by day of each user as a five-channel forecast text, parsed and exploded by channel."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    daily = e.groupBy("user_id", "day").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))
    line = F.concat(F.lit("("), F.col("day"), F.lit(": "), F.concat_ws(", ", *(F.col(k).cast("string") for k in kinds)), F.lit(")"))
    rows = daily.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("answer"))
    rows = rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), parse_forecast(F.col("answer")).alias("parsed"), F.array(*(F.lit(k) for k in kinds)).alias("names"))
    out = N.explode_channels(rows, "parsed", "names")
    return out.select("id", "channel_index", "channel_name", F.explode("target").alias("t")).select("id", "channel_index", "channel_name", "t.pos", "t.label", "t.value")


def series_stats(spark: SparkSession, d: str) -> DataFrame:
    out = N.series_stats(table(spark, d, "telemetry"), ["timeseries_path"], "vEgo")
    return out.select("timeseries_path", F.round("mean", 5).alias("mean"), F.round("sigma", 5).alias("sigma"))


def series_znorm(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "telemetry").where(~F.isnan("vEgo") & (F.abs("vEgo") < F.lit(float("inf")))).select("reading_id", "timeseries_path", "vEgo")
    z = t.join(N.series_stats(t, ["timeseries_path"], "vEgo"), "timeseries_path")
    return z.select("reading_id", (F.round(N.znormalize(F.col("vEgo"), F.col("mean"), F.col("sigma")), 4) + F.lit(0.0)).alias("z"))


def masked_loss(spark: SparkSession, d: str) -> DataFrame:
    out = N.masked_mse(table(spark, d, "telemetry"), ["vehicle_id"], F.col("lead_a"), F.col("aEgo"), F.col("lead_a").isNotNull() & F.col("aEgo").isNotNull())
    return out.select("vehicle_id", F.round("loss", 6).alias("loss"))


def series_pad(spark: SparkSession, d: str) -> DataFrame:
    """A counter of the events of each user and type as one channel, padded to the type's longest."""
    t = table(spark, d, "events").withColumn("day", F.date_format("ts", "dd").cast("int"))
    long = t.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).select("user_id", "event_type", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("step"), F.lit(0).alias("channel_index"))
    out = pad_series(long.withColumn("value", F.col("step").cast("double")), ["user_id"], ["event_type"])
    return out.select("event_type", "user_id", "n_steps", "n_channels", F.size("values").alias("width"), F.size(F.filter("values", lambda v: F.isnan(v))).alias("n_padding"))


def _clip_channels(spark: SparkSession, d: str) -> DataFrame:
    """Long form of the clips' series: every measured channel, numbered as in the table; resent readings once."""
    t = table(spark, d, "telemetry")
    names = [n for n, kind in t.dtypes if kind == "double"]
    once = t.groupBy("vehicle_id", "timeseries_path", "timestamp").agg(F.min_by(F.struct(*names), "reading_id").alias("x"))
    step = F.row_number().over(W.partitionBy("vehicle_id", "timeseries_path").orderBy("timestamp")) - 1
    long = once.withColumn("step", step).select("vehicle_id", "timeseries_path", "step", F.posexplode(F.array(*(F.struct(F.lit(n).alias("channel"), F.col(f"x.{n}").alias("value")) for n in names))).alias("channel_index", "y"))
    return long.select("vehicle_id", "timeseries_path", "step", "channel_index", "y.channel", "y.value")


def series_pad_clips(spark: SparkSession, d: str) -> DataFrame:
    """Readings of each clip of a vehicle by channel, padded to the vehicle's longest clip."""
    out = pad_series(_clip_channels(spark, d), ["timeseries_path"], ["vehicle_id"])
    known = lambda v: F.size(F.filter(v, lambda x: ~F.isnan(x)))
    padding = F.slice("values", F.col("n_steps") + 1, F.size("values"))
    return out.select("vehicle_id", "timeseries_path", "channel_index", "n_steps", "n_channels", F.size("values").alias("width"), known("values").alias("n_known"), (F.size(padding) - known(padding)).alias("n_padding"))


def single_target_clips(spark: SparkSession, d: str) -> DataFrame:
    """The road speed of each clip as a target; the channel numbers are those of the series."""
    out = single_channel(_clip_channels(spark, d).where("channel = 'vEgo'"), ["timeseries_path"])
    return out.groupBy("timeseries_path").agg(F.count("*").alias("n"), F.count(F.nanvl("value", F.lit(None))).alias("n_known"), F.max(F.nanvl("value", F.lit(None))).alias("top"))


def single_target(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "events").select("user_id", F.lit(0).alias("channel_index"), "value")
    return single_channel(long, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def text_shape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", series_shape(F.col("text")).alias("s")).select("doc_id", F.col("s")[0].alias("steps"), F.col("s")[1].alias("channels"))


def meta_derived(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("video_meta")
    out = table(spark, d, _M).select("row_no", complete_video_meta(v["nb_frames"], v["duration"], v["source_fps"]).alias("x"))
    return out.select("row_no", "x.nb_frames", F.round("x.duration", 6).alias("duration"))


def clip_seconds(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "clips").select("timeseries_path", clip_times(F.col("start_frame"), F.col("end_frame"), F.lit(20.0)).alias("x"))
    return out.select("timeseries_path", F.round("x.start_sec", 6).alias("start_sec"), F.round("x.duration_sec", 6).alias("duration_sec"))


def frame_plan(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("video_meta")
    m = table(spark, d, _M).where("video_meta.nb_frames > 0").select("row_no", v["nb_frames"].alias("total"), frame_count(v["duration"], v["source_fps"], F.lit(1.0), 4, 16).alias("n"))
    return m.select("row_no", "n", F.array_join(F.transform(midpoints(F.col("total"), F.col("n")), lambda x: x.cast("string")), ",").alias("frames"))


def sampled(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("video_meta")
    return table(spark, d, _M).where("video_meta is not null").select("row_no", sampled_frames(v["nb_frames"], F.coalesce(v["source_fps"], F.lit(0.0)), LengthConfig()).alias("n_frames"))


def vis_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _M).select("row_no", video_tokens(F.col("video_meta")).alias("n"))


def img_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _M).select("row_no", image_tokens(F.col("image_meta")).alias("n"))


def ts_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _M).select("row_no", series_tokens(F.col("ts_shape")).alias("n"))


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    words = F.size(F.filter(F.split(F.col("prompt"), r"[ \n\t\r]+"), lambda w: w != ""))
    n = sequence_length(words, F.col("video_path"), F.col("video_meta"), F.col("image_path"), F.col("image_meta"), F.col("ts_shape"))
    return table(spark, d, _M).select("row_no", "source", "task", n.alias("n"))


def seq_length(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d).select("row_no", "n")


def len_summary(spark: SparkSession, d: str) -> DataFrame:
    out = length_summary(_lengths(spark, d), "n", ["source"])
    return out.select("source", "n", "min_len", "p50", "p95", "max_len", F.round("mean_len", 6).alias("mean_len"))


def _in_order(spark: SparkSession, d: str) -> DataFrame:
    rows = _lengths(spark, d)
    most = rows.agg(F.max("row_no")).first()[0] or 0
    return rows.withColumn("_k", F.col("row_no") / F.lit(float(most + 1)))


def pack_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = _in_order(spark, d)
    return plan_batches(rows, "row_no", "n", "task", 40000, 32, 200, key=F.col("_k")).withColumnRenamed("item", "row_no")


def pack_steps(spark: SparkSession, d: str) -> DataFrame:
    return plan_steps(plan_batches(_lengths(spark, d), "row_no", "n", "task", 40000, 32), 2).withColumnRenamed("item", "row_no")


def rank_shards(spark: SparkSession, d: str) -> DataFrame:
    rows = _in_order(spark, d)
    placed = ordinals(rows, "at", [], F.col("_k"), ["row_no"]).withColumn("n_all", F.lit(rows.count()))
    return shard(placed, "at", 4, F.col("n_all")).select("row_no", "rank", "turn")


def conversation_build(spark: SparkSession, d: str) -> DataFrame:
    m = V.ablate(table(spark, d, _M))
    conv = V.build_conversation(
        F.col("prompt"), F.col("answer"), F.col("video_path"), F.col("image_path"), F.col("timeseries_path"), F.col("task"), F.col("use_vision"), F.col("use_series"), strip_block, ("prediction",))
    turns = m.select("row_no", "ablation", F.posexplode(V.mark_series(conv)).alias("turn", "t"))
    return turns.select("row_no", "ablation", "turn", F.col("t.role").alias("role"), F.posexplode("t.content").alias("pos", "e")).select("row_no", "ablation", "turn", "role", "pos", "e.type", "e.value")


def placeholder_expand(spark: SparkSession, d: str) -> DataFrame:
    text = F.lit("a" + V.TS_PLACEHOLDER + "b" + V.TS_PLACEHOLDER)
    return table(spark, d, "part").select("p_partkey", F.length(V.expand_placeholder(text, F.col("p_size") % 7)).alias("n_chars"))


def image_cap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _M).select("row_no", F.coalesce(F.size(V.cap_images(F.col("image_path"), F.lit(47))), F.lit(0)).alias("n_images"))


def dataset_folder(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _M).where("id is not null").select("row_no", safe_name(F.col("id")).alias("folder"))


def _grid():  # noqa: ANN202
    k, s = F.col("p_partkey"), F.col("p_size")
    return (s % 4 + 1).cast("int"), (s % 3 + 1).cast("int"), (k % 5 + 1).cast("int"), (k % 3 + 1).cast("int")


def interleave(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "part").select("p_partkey", F.posexplode(L.interleave(*_grid())).alias("pos", "x"))
    return out.select("p_partkey", "pos", "x.kind", "x.at", "x.sub")


def merge_by_time(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("kind"), (F.col("event_id") % 3 + 1).alias("width"))
    return L.merge_by_time(e, ["user_id"], "at", "kind", "width").select("event_id", "token_pos")


#: Token ids of the synthetic sequences: text, video, series, their markers, header and end mark. Fixed values.
_T, _VID, _SER, _S0, _S1, _V0, _V1, _END = 50, 1, 2, 3, 4, 900, 901, 7
_HEADER = [5, 6, 8]


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """text, vision start, video.., vision end, text, series start, series.., series end, header, reply, end mark, text."""
    t, s, p, c = _grid()
    run = lambda x, n: F.array_repeat(F.lit(x), n)
    lits = lambda *xs: F.array(*(F.lit(x) for x in xs))
    ids = F.concat(lits(_T, _V0), run(_VID, t * s), lits(_V1, _T, _S0), run(_SER, p * c), lits(_S1, *_HEADER), run(_T, (F.col("p_partkey") % 4).cast("int")), lits(_END, _T))
    return table(spark, d, "part").select("p_partkey", ids.alias("ids"), t.alias("t"), s.alias("s"), p.alias("p"), c.alias("c"))


def weave_tokens(spark: SparkSession, d: str) -> DataFrame:
    x = _tokens(spark, d)
    woven = L.weave_tokens(F.col("ids"), _VID, _SER, _S0, _S1, F.col("t"), F.col("s"), F.col("p"), F.col("c"))
    return x.select("p_partkey", F.array_join(F.transform(woven, lambda v: v.cast("string")), " ").alias("ids"))


def label_mask(spark: SparkSession, d: str) -> DataFrame:
    x = _tokens(spark, d).select("p_partkey", F.posexplode(L.mask_labels(F.col("ids"), _HEADER, _END)).alias("pos", "label"))
    return x.groupBy("p_partkey").agg(F.count_if(F.col("label") != -100).alias("n_trained"), F.min(F.when(F.col("label") != -100, F.col("pos"))).alias("first"), F.max(F.when(F.col("label") != -100, F.col("pos"))).alias("last"))


def token_census(spark: SparkSession, d: str) -> DataFrame:
    x = _tokens(spark, d)
    return x.select("p_partkey", L.census(F.col("ids"), F.transform("ids", lambda v: F.lit(1)), {"video": _VID, "series": _SER}).alias("n")).select("p_partkey", "n.*")


def rope_positions(spark: SparkSession, d: str) -> DataFrame:
    x = _tokens(spark, d).withColumns({"grids": F.array(F.array(F.col("t"), F.col("s") * 2, F.lit(2))), "pace": F.array(F.lit(1.0))})
    marks = {"video": _VID, "series": _SER, "ts_start": _S0, "ts_end": _S1, "vision_start": _V0, "vision_end": _V1}
    out = L.rope_positions(x, "ids", "c", "grids", "pace", marks, merge=2, pps=1.0)
    zipped = F.arrays_zip(F.col("positions")[0].alias("t"), F.col("positions")[1].alias("h"), F.col("positions")[2].alias("w"))
    return out.select("p_partkey", "delta", F.posexplode(zipped).alias("pos", "p")).select("p_partkey", "delta", "pos", F.col("p.t").alias("t"), F.col("p.h").alias("h"), F.col("p.w").alias("w"))


def target_pad(spark: SparkSession, d: str) -> DataFrame:
    values = F.transform(F.sequence(F.lit(1), (F.col("p_size") % 6 + 1).cast("int")), lambda i: i.cast("double"))
    x = table(spark, d, "part").select("p_partkey", L.pad_target(values, 6).alias("x"))
    return x.select("p_partkey", F.size("x.target").alias("width"), F.size(F.filter("x.mask", lambda m: m)).alias("n_valid"), "x.len")


def group_ids(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select("p_partkey", F.posexplode(L.group_ids(F.array((F.col("p_size") % 3).cast("int"), (F.col("p_partkey") % 4).cast("int"), F.lit(2)))).alias("pos", "group"))
    return x


def time_first(spark: SparkSession, d: str) -> DataFrame:
    _, _, p, c = _grid()
    return table(spark, d, "part").select("p_partkey", F.posexplode(L.time_first(c, p, p + 2)).alias("pos", "place"))


def series_window(spark: SparkSession, d: str) -> DataFrame:
    x = _tokens(spark, d)
    return x.select("p_partkey", L.series_window(F.col("ids"), _SER, 3).alias("w")).select("p_partkey", F.col("w")[0].alias("first"), F.col("w")[2].alias("last"))


def score_stub(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, _M).select("row_no", "id", "answer", "task").where("task = 'classification'")
    out = score_rows(rows.select("id", "answer"), EchoScorer, batch_size=8)
    return out.select("id", "ground_truth", "raw", "failed")


def annotate_state(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("video_path", "video_meta", "image_path", "image_meta", "ts_shape")]
    x = table(spark, d, _M).select("row_no", A.todo(F.col("video_meta"), F.col("timeseries_path"), F.col("ts_shape")).alias("t"), A.usable_meta(*c).alias("u"))
    return x.select("row_no", F.col("t.video").alias("todo_video"), F.col("t.series").alias("todo_series"), F.col("u.video").alias("has_video"), F.col("u.images").alias("has_images"), F.col("u.series").alias("has_series"))


def annotate_coverage(spark: SparkSession, d: str) -> DataFrame:
    return A.coverage(table(spark, d, _M), ["source"])


def batch_rejects(spark: SparkSession, d: str) -> DataFrame:
    why = A.why_not(F.col("task"), F.col("timeseries_path"), F.col("forecast_target_path"))
    return table(spark, d, _M).select("source", why.alias("why")).where("why is not null").groupBy("source", "why").agg(F.count("*").alias("n"))


def request_plan(spark: SparkSession, d: str) -> DataFrame:
    v, k = F.col("video_meta"), F.coalesce(F.size("image_path"), F.lit(0))
    m = table(spark, d, _M).where("video_meta.width > 0 and video_meta.height > 0 and video_meta.nb_frames is not null").select("row_no", A.request_frames(v, k).alias("n_frames"), A.capped_size(v["width"], v["height"], 128 * 784).alias("s"))
    return m.select("row_no", "n_frames", "s.width", "s.height")


def request_parts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, _M).select("row_no", F.posexplode(A.request_parts(A.square_tags(F.col("prompt")), F.col("image_path"), F.lit(2))).alias("pos", "p"))
    return x.select("row_no", "pos", "p.type", "p.value")


QUERIES = {f.__name__: f for f in (
    normalize_rows, normalize_counts, image_paths, multi_source_union, short_clip_filter, source_counts, resume_anti, resume_retry, strip_prompt, block_values, thin_prompt, picks,
    explode_channels, series_stats, series_znorm, masked_loss, series_pad, series_pad_clips, single_target, single_target_clips, text_shape, meta_derived, clip_seconds, frame_plan, sampled, vis_tokens, img_tokens, ts_tokens, seq_length,
    len_summary, pack_batches, pack_steps, rank_shards, conversation_build, placeholder_expand, image_cap, dataset_folder, interleave, merge_by_time, weave_tokens, label_mask, token_census,
    rope_positions, target_pad, group_ids, time_first, series_window, score_stub,
    annotate_state, annotate_coverage, batch_rejects, request_plan, request_parts)}

_LINE = """rtrim(split_part(props, '}', 1)) || case event_id % 4 when 0 then ', "video_id": "v' || event_id || '"' when 1 then ', "id": "i' || event_id || '", "task": null'
    when 2 then ', "id": "old", "video_id": "v' || event_id || '", "task": "prediction"' else '' end || '}'"""
_NORMAL = f"""
    lines as (select event_id, event_type, {_LINE} as line from events),
    normal as (
      select event_id, event_type, case when list_contains(json_keys(line), 'video_id') then line->>'$.video_id' else line->>'$.id' end as id,
        case when list_contains(json_keys(line), 'task') then line->>'$.task' else 'classification' end as task,
        list_contains(json_keys(line), 'video_id') and not list_contains(json_keys(line), 'id') as renamed, not list_contains(json_keys(line), 'task') as task_added from lines)"""
_RESIZED = """
      select *, case when w > 0 and h > 0 and greatest(w, h) <= 200 * least(w, h) then
        case when rh * rw > hi then greatest(28, floor(h / sqrt(h * w / hi) / 28) * 28) when rh * rw < lo then ceil(h * sqrt(lo / (h * w)) / 28) * 28 else rh end end as oh,
        case when w > 0 and h > 0 and greatest(w, h) <= 200 * least(w, h) then
        case when rh * rw > hi then greatest(28, floor(w / sqrt(h * w / hi) / 28) * 28) when rh * rw < lo then ceil(w * sqrt(lo / (h * w)) / 28) * 28 else rw end end as ow
      from (select *, round_even(h / 28, 0) * 28 as rh, round_even(w / 28, 0) * 28 as rw from {0})"""
_FRAMES = """greatest(2, floor(least(least(greatest(n / fps * 1.0, 4), floor(least(80, n) / 2) * 2), n) / 2) * 2)"""
_LENGTHS = f"""
    vin as (select row_no, video_meta.nb_frames::double as n, coalesce(video_meta.source_fps, 0)::double as fps, video_meta.height::double as h, video_meta.width::double as w,
      (64 * 784)::double as lo, (128 * 784)::double as hi from manifest),
    vres as ({_RESIZED.format('vin')}),
    vis as (select row_no, case when n > 0 then coalesce(floor(floor((case when fps <= 0 then 2 else {_FRAMES} end) / 2) * floor(oh / 14) * floor(ow / 14) / 4), 0) else 0 end::bigint as vn from vres),
    iin as (select row_no, m.height::double as h, m.width::double as w, (128 * 784)::double as lo, (256 * 784)::double as hi from (select row_no, unnest(image_meta) as m from manifest)),
    ires as ({_RESIZED.format('iin')}),
    img as (select m.row_no, coalesce(sum(floor(floor(oh / 14) * floor(ow / 14) / 4)), 0)::bigint as inn from manifest m left join ires using (row_no) group by all),
    ser as (
      select row_no, coalesce(len(ts_shape) = 2 and ts_shape[1] >= 0 and ts_shape[2] >= 0, false) as known,
        case when coalesce(len(ts_shape) = 2 and ts_shape[1] >= 0 and ts_shape[2] >= 0, false) then (ceil(ts_shape[1] / 16.0) * ts_shape[2])::bigint else 0 end as sn from manifest),
    words as (select row_no, len(list_filter(regexp_split_to_array(prompt, '[ \\n\\t\\r]+'), lambda x: x <> ''))::bigint as wn from manifest),
    parts as (
      select m.row_no, m.source, m.task, case when video_path is not null then greatest(0, wn - 1) + vn else wn end as a, image_path, inn, known, sn
      from manifest m join vis using (row_no) join img using (row_no) join ser using (row_no) join words using (row_no)),
    summed as (select *, case when image_path is not null then greatest(0, a - len(image_path)) + inn else a end as b from parts),
    lengths as (select row_no, source, task, (case when known then b - 1 + sn else b end)::bigint as n from summed)"""
_GRID = "(p_size % 4 + 1) as t, (p_size % 3 + 1) as s, (p_partkey % 5 + 1) as p, (p_partkey % 3 + 1) as c"

SQL = {
    "normalize_rows": f"with {_NORMAL} select event_id, id, task, renamed, task_added from normal",
    "normalize_counts": f"with {_NORMAL} select event_type, count(*) as n_rows, count(*) filter (renamed) as n_renamed, count(*) filter (task_added) as n_task_added from normal group by all",
    "image_paths": "select row_no, array_to_string(case when len(image_path) > 0 then image_path else [] end, '|') as paths, coalesce(len(image_path), 0)::int as n from manifest",
    "multi_source_union": """select 0 as source_id, 'customer' as source_name, c_custkey as key, c_name as name, c_mktsegment as segment from customer
        union all select 1, 'supplier', s_suppkey, s_name, null from supplier""",
    "short_clip_filter": "select row_no, source from manifest where coalesce(video_meta.nb_frames >= 120, true)",
    "source_counts": "select source, count(*) filter (coalesce(video_meta.nb_frames >= 120, true)) as n_kept, count(*) filter (not coalesce(video_meta.nb_frames >= 120, true)) as n_dropped from manifest group by all",
    "resume_anti": "select row_no, id from manifest m where not exists (select 1 from predictions p where p.id = m.id)",
    "resume_retry": "select row_no, id from manifest m where not exists (select 1 from predictions p where p.id = m.id and not coalesce(failed, false))",
    "strip_prompt": "select row_no, regexp_replace(prompt, '<timeseries>.*?</timeseries>', '', 'gs') as prompt from manifest",
    "block_values": r"""
        with body as (select row_no, regexp_extract(prompt, '<timeseries>(.*?)</timeseries>', 1, 's') as b from manifest where regexp_matches(prompt, '<timeseries>.*?</timeseries>', 's')),
        lines as (select row_no, unnest(list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '^[0-9.]+:\s*\S'))) as line, generate_subscripts(list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '^[0-9.]+:\s*\S')), 1) - 1 as step from body),
        pairs as (select row_no, step, try_cast(regexp_extract(line, '^([0-9.]+):', 1) as double) as t, unnest(string_split(regexp_extract(line, '^[0-9.]+:\s*(.+)$', 1), ',')) as kv from lines)
        select row_no, step::int as step, t, trim(split_part(kv, '=', 1)) as channel,
          case when regexp_matches(trim(substr(kv, instr(kv, '=') + 1)), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') then try_cast(trim(substr(kv, instr(kv, '=') + 1)) as double) end as value
        from pairs where contains(kv, '=')""",
    "thin_prompt": r"""
        with b as (select row_no, prompt, instr(prompt, '<timeseries>') + 11 as o from manifest),
        c as (select *, substr(prompt, o + 1) as rest from b),
        d as (select *, instr(rest, '</timeseries>') as e from c),
        l as (select *, regexp_split_to_array(regexp_replace(substr(rest, 1, e - 1), '(\r\n|[\n\r])$', ''), '\r\n|[\n\r]') as lines from d where o > 11 and e > 0),
        n as (select *, list_filter(range(1, len(lines) + 1), lambda i: regexp_matches(lines[i], '^\s*[0-9.]+\s*:\s*\S')) as ix from l),
        k as (select *, case when len(ix) > 3 then list_transform([0, round_even((len(ix) - 1) / 2.0, 0)::bigint, len(ix) - 1], lambda i: ix[i + 1]) else ix end as keep from n),
        t as (
          select row_no, o, e, prompt, rest, list_transform(list_filter(range(1, len(lines) + 1), lambda i: not list_contains(ix, i) or list_contains(keep, i)), lambda i:
            case when list_contains(ix, i) then list_reduce(list_transform(range(1, len(regexp_split_to_array(lines[i], '-?[0-9]+\.[0-9]+')) + 1), lambda j:
              regexp_split_to_array(lines[i], '-?[0-9]+\.[0-9]+')[j] || coalesce(format('{:.1f}', regexp_extract_all(lines[i], '-?[0-9]+\.[0-9]+')[j]::double), '')), lambda x, y: x || y)
            else lines[i] end) as kept from k)
        select row_no, coalesce(substr(t.prompt, 1, o) || array_to_string(kept, chr(10)) || substr(rest, e), m.prompt) as prompt from manifest m left join t using (row_no)""",
    "picks": """with x as (select p_partkey, (p_partkey % 97 + 2) as n, (p_size % 12 + 1) as m from part), y as (select p_partkey, n, m, unnest(range(0, m)) as i from x)
        select distinct p_partkey, (case when m = 1 then 0 when i = m - 1 then n - 1 else round_even(i * ((n - 1)::double / (m - 1)), 0) end)::int as pick from y""",
    "explode_channels": """
        with daily as (select user_id, strftime(ts, '%Y-%m-%d') as label, event_type from events),
        days as (select user_id, label, row_number() over (partition by user_id order by label) - 1 as pos from (select distinct user_id, label from daily)),
        kinds as (select * from (values (0, 'click'), (1, 'error'), (2, 'purchase'), (3, 'signup'), (4, 'view')) as k(channel_index, channel_name))
        select 'u' || d.user_id || '__ch' || channel_index as id, channel_index, channel_name, pos::int as pos, d.label, count(e.event_type)::double as value
        from days d cross join kinds k left join daily e on e.user_id = d.user_id and e.label = d.label and e.event_type = k.channel_name group by all""",
    "series_stats": """select timeseries_path, round(coalesce(avg(v), 0), 5) as mean, round(sqrt(coalesce(var_pop(v), 0) + 1e-6), 5) as sigma
        from (select timeseries_path, case when isfinite("vEgo") then "vEgo" end as v from telemetry) group by all""",
    "series_znorm": """with t as (select reading_id, timeseries_path, "vEgo" as v from telemetry where isfinite("vEgo")),
        s as (select timeseries_path, avg(v) as m, sqrt(var_pop(v) + 1e-6) as sd from t group by all) select reading_id, round((v - m) / sd, 4) + 0.0::double as z from t join s using (timeseries_path)""",
    "masked_loss": """select vehicle_id, round(coalesce(sum((lead_a - "aEgo") * (lead_a - "aEgo")), 0) / greatest(1, count(lead_a - "aEgo")), 6) as loss from telemetry group by all""",
    "series_pad": """with x as (select event_type, user_id, count(*) as n from events group by all), y as (select event_type, max(n) as w from x group by all)
        select event_type, user_id, n::int as n_steps, 1 as n_channels, w::int as width, (w - n)::int as n_padding from x join y using (event_type)""",
    "series_pad_clips": """with o as (select vehicle_id, timeseries_path, timestamp, min(reading_id) as reading_id from telemetry group by all),
        r as (select t.* from telemetry t join o using (reading_id)),
        long as (select vehicle_id, timeseries_path, timestamp, unnest(range(0, 5))::int as channel_index, unnest(["vEgo", "aEgo", "steeringAngleDeg", lead_speed_kmh, lead_a]) as value from r),
        x as (select vehicle_id, timeseries_path, channel_index, count(*) as n, count(*) filter (value is not null and not isnan(value)) as n_known from long group by all),
        y as (select vehicle_id, max(n) as w from x group by all)
        select vehicle_id, timeseries_path, channel_index, n::int as n_steps, 5 as n_channels, w::int as width, n_known::int as n_known, (w - n)::int as n_padding from x join y using (vehicle_id)""",
    "single_target_clips": """with o as (select vehicle_id, timeseries_path, timestamp, min(reading_id) as reading_id from telemetry group by all),
        r as (select t.timeseries_path, case when not isnan(t."vEgo") then t."vEgo" end as v from telemetry t join o using (reading_id))
        select timeseries_path, count(*) as n, count(v) as n_known, max(v) as top from r group by all""",
    "single_target": "select user_id, count(*) as n, round(sum(value), 4) as total from events group by all",
    "text_shape": r"""with b as (select doc_id, regexp_replace(text, '\r?\n\z', '') as x from documents)
        select doc_id, case when length(x) > 0 then (len(regexp_split_to_array(x, '\r?\n')) - 1)::int end as steps,
          case when length(x) > 0 then len(list_filter(string_split(regexp_split_to_array(x, '\r?\n')[1], ','), lambda c: trim(c) <> 'timestamp'))::int end as channels from b""",
    "meta_derived": """
        with v as (select row_no, video_meta.nb_frames as n, video_meta.duration as s, video_meta.source_fps as f from manifest),
        x as (select *, case when coalesce(n, 0) <= 0 and s > 0 and f > 0 then floor(s * f)::int else n end as m from v)
        select row_no, m as nb_frames, round(case when coalesce(s, 0) <= 0 and m > 0 and f > 0 then m / f else s end, 6) as duration from x""",
    "clip_seconds": "select timeseries_path, round(start_frame / 20.0::double, 6) as start_sec, round(greatest(1e-3, (end_frame - start_frame + 1) / 20.0::double), 6) as duration_sec from clips",
    "frame_plan": """
        with v as (select row_no, video_meta.nb_frames as total, coalesce(greatest(4, least(16, round_even(video_meta.duration * 1.0, 0)::int)), 16) as n from manifest where video_meta.nb_frames > 0)
        select row_no, n::int as n, array_to_string(list_transform(range(0, n), lambda i: greatest(0, least(total - 1, floor(total::double / n * (i + 0.5))::int))), ',') as frames from v""",
    "sampled": f"with v as (select row_no, video_meta.nb_frames::double as n, coalesce(video_meta.source_fps, 0)::double as fps from manifest where video_meta is not null) select row_no, (case when n <= 0 or fps <= 0 or n is null then 2 else {_FRAMES} end)::bigint as n_frames from v",
    "vis_tokens": f"with {_LENGTHS} select row_no, vn as n from vis",
    "img_tokens": f"with {_LENGTHS} select row_no, inn as n from img",
    "ts_tokens": f"with {_LENGTHS} select row_no, sn as n from ser",
    "seq_length": f"with {_LENGTHS} select row_no, n from lengths",
    "len_summary": f"""with {_LENGTHS}, r as (select source, n, row_number() over (partition by source order by n) - 1 as k, count(*) over (partition by source) as c from lengths where n is not null)
        select source, max(c) as n, min(n) as min_len, min(n) filter (k = c // 2) as p50, min(n) filter (k = floor(c * 0.95)) as p95, max(n) as max_len, round(sum(n)::double / max(c), 6) as mean_len from r group by source""",
    "pack_batches": f"""
        with recursive {_LENGTHS},
        placed as (select task, row_no as item, coalesce(n, 0) as len, row_number() over (partition by task order by row_no) - 1 as k from lengths),
        ranked as (select task, k // 200 as bucket, item, len, row_number() over (partition by task, k // 200 order by len, k) as r from placed),
        walk(task, bucket, r, item, len, batch, pos) as (
          select task, bucket, r, item, len, 0, 0 from ranked where r = 1
          union all
          select n.task, n.bucket, n.r, n.item, n.len, case when n.len * (w.pos + 2) <= 40000 and w.pos + 1 < 32 then w.batch else w.batch + 1 end,
            case when n.len * (w.pos + 2) <= 40000 and w.pos + 1 < 32 then w.pos + 1 else 0 end
          from walk w join ranked n on n.task is not distinct from w.task and n.bucket = w.bucket and n.r = w.r + 1)
        select task, bucket::bigint as bucket, batch::int as batch, pos::int as pos, item as row_no, len from walk""",
    "rank_shards": "with x as (select row_no, row_number() over (order by row_no) - 1 as k, count(*) over () as n from manifest) select row_no, (k % 4)::int as rank, (k // 4)::bigint as turn from x where k < n // 4 * 4",
    "conversation_build": """
        with m as (select *, unnest([{'ablation': 'full', 'v': true, 's': true}, {'ablation': 'no_vision', 'v': false, 's': true}, {'ablation': 'no_timeseries', 'v': true, 's': false}], recursive := true) from manifest),
        turns as (
          select row_no, ablation, 0 as turn, 'user' as role, list_concat(
              case when v and video_path <> '' then [{'type': 'video', 'value': video_path}] else [] end,
              case when v and image_path is not null then list_transform(image_path, lambda x: {'type': 'image', 'value': x}) else [] end,
              case when s then [{'type': 'text', 'value': '<|ts_start|><|ts_placeholder|><|ts_end|>'}] else [] end,
              [{'type': 'text', 'value': case when coalesce(task = 'prediction', false) then prompt else regexp_replace(prompt, '<timeseries>.*?</timeseries>', '', 'gs') end}]) as content from m
          union all select row_no, ablation, 1, 'assistant', [{'type': 'text', 'value': answer}] from m where answer is not null)
        select row_no, ablation, turn, role, pos, e.type as type, e.value as value
        from (select row_no, ablation, turn, role, (generate_subscripts(content, 1) - 1)::int as pos, unnest(content) as e from turns)""",
    "placeholder_expand": "select p_partkey, (2 + 18 + 18 * (p_size % 7))::int as n_chars from part",
    "image_cap": "select row_no, case when image_path is null then 0 else least(len(image_path), 3) end::int as n_images from manifest",
    "dataset_folder": "select row_no, regexp_replace(id, '[^A-Za-z0-9._-]', '_', 'g') as folder from manifest where id is not null",
    "interleave": f"""
        with g as (select p_partkey, {_GRID} from part),
        v as (select p_partkey, step, 0 as k, step as a, unnest(range(0, s)) as sub from (select *, unnest(range(0, t)) as step from g)),
        q as (select p_partkey, least(t - 1, i * t // p) as step, 1 as k, i as a, unnest(range(0, c)) as sub from (select *, unnest(range(0, p)) as i from g))
        select p_partkey, (row_number() over (partition by p_partkey order by step, k, a, sub) - 1)::int as pos, case k when 0 then 'V' else 'T' end as kind, a::int as at, sub::int as sub
        from (select * from v union all select * from q)""",
    "merge_by_time": "select event_id, coalesce(sum(event_id % 3 + 1) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0)::bigint as token_pos from events",
    "weave_tokens": f"""
        with g as (select p_partkey, {_GRID} from part),
        v as (select p_partkey, step, 0 as k, step as a, unnest(range(0, s)) as sub from (select *, unnest(range(0, t)) as step from g)),
        q as (select p_partkey, least(t - 1, i * t // p) as step, 1 as k, i as a, unnest(range(0, c)) as sub from (select *, unnest(range(0, p)) as i from g)),
        mid as (select p_partkey, string_agg(case k when 0 then '1' else '2' end, ' ' order by step, k, a, sub) as x from (select * from v union all select * from q) group by all)
        select p_partkey, '50 900 3 ' || x || ' 4 901 50 5 6 8 ' || repeat('50 ', p_partkey % 4) || '7 50' as ids from mid""",
    "label_mask": f"with g as (select p_partkey, {_GRID} from part) select p_partkey, p_partkey % 4 + 1 as n_trained, (5 + t * s + p * c + 4)::int as first, (5 + t * s + p * c + 4 + p_partkey % 4)::int as last from g",
    "token_census": f"with g as (select p_partkey, {_GRID} from part) select p_partkey, (t * s)::int as video, (p * c)::int as series, (11 + t * s + p * c + p_partkey % 4)::int as valid, (11 + p_partkey % 4)::int as text from g",
    "target_pad": "select p_partkey, 6 as width, (p_size % 6 + 1)::int as n_valid, (p_size % 6 + 1)::int as len from part",
    "group_ids": """with x as (select p_partkey, list_concat(list_transform(range(0, p_size % 3), lambda i: 0), list_transform(range(0, p_partkey % 4), lambda i: 1), [2, 2]) as l from part)
        select p_partkey, (generate_subscripts(l, 1) - 1)::int as pos, unnest(l)::int as "group" from x""",
    "time_first": f"""with g as (select p_partkey, {_GRID} from part), q as (select p_partkey, p, c, i, unnest(range(0, c)) as j from (select *, unnest(range(0, p)) as i from g))
        select p_partkey, (i * c + j)::int as pos, (j * (p + 2) + i)::int as place from q""",
    "series_window": f"with g as (select p_partkey, {_GRID} from part) select p_partkey, (t * s + 5)::int as first, (t * s + 7)::int as last from g",
    "score_stub": "select id, answer as ground_truth, 'the answer is ' || answer as raw, false as failed from manifest where task = 'classification'",
    "annotate_state": """select row_no, video_meta is null as todo_video, coalesce(timeseries_path, '') <> '' and ts_shape is null as todo_series,
        coalesce(video_path <> '' and video_meta.width is not null and video_meta.height is not null and video_meta.source_fps is not null and video_meta.nb_frames is not null, false) as has_video,
        coalesce(len(image_path) > 0 and len(image_meta) = len(image_path), false) as has_images, coalesce(len(ts_shape) = 2, false) as has_series from manifest""",
    "annotate_coverage": "select source, count(*) as n, count(video_meta) as n_video_meta, count(ts_shape) as n_ts_shape from manifest group by all",
    "batch_rejects": """select source, case when task is distinct from 'prediction' then 'task' when timeseries_path is null then 'series' when forecast_target_path is null then 'target' end as why, count(*) as n
        from manifest where task is distinct from 'prediction' or timeseries_path is null or forecast_target_path is null group by all""",
    "request_plan": """
        with m as (select row_no, video_meta.width as w, video_meta.height as h, video_meta.nb_frames as n, video_meta.source_fps as f, video_meta.duration as s, coalesce(len(image_path), 0) as k
          from manifest where video_meta.width > 0 and video_meta.height > 0 and video_meta.nb_frames is not null),
        t as (select *, case when s > 0 then s when f <> 0 then coalesce(n / f, 0) else 0 end as sec, sqrt(128 * 784 / (w::double * h)) as z from m)
        select row_no, greatest(4, least(80, greatest(1, 50 - k), greatest(1, round_even(sec, 0)::int)))::int as n_frames,
          (case when w * h > 128 * 784 then greatest(1, floor(w * z)) else w end)::int as width, (case when w * h > 128 * 784 then greatest(1, floor(h * z)) else h end)::int as height from t""",
    "request_parts": """
        with m as (select row_no, list_concat([{'type': 'text', 'value': replace(replace(prompt, '<video>', '[video]'), '</video>', '[/video]')}, {'type': 'frame', 'value': '0'}, {'type': 'frame', 'value': '1'}],
          case when image_path is null then [] else list_transform(image_path[1:48], lambda x: {'type': 'image', 'value': x}) end) as l from manifest)
        select row_no, pos, e.type as type, e.value as value from (select row_no, (generate_subscripts(l, 1) - 1)::int as pos, unnest(l) as e from m)""",
}
