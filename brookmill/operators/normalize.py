"""Manifest rows made uniform: renames and defaults, image lists, channel explosion, filters, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.functions.forecast import forecast_text, parse_forecast


def normalize_rows(df: DataFrame, line: str) -> DataFrame:
    """Adds ``id``, ``task``, ``renamed`` and ``task_added``, read from JSON objects in ``line``.

    ``video_id``, if the key is there, becomes the id, whatever id there was; a row without the key ``task`` is a
    classification, one whose task is null keeps null. ``renamed`` counts only rows that had no id. A line that isn't
    JSON gives nulls.
    """
    v = F.try_parse_json(line)
    has = lambda k: F.coalesce(F.array_contains(F.json_object_keys(line), k), F.lit(False))
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    return df.withColumns({
        "id": F.when(has("video_id"), text("video_id")).otherwise(text("id")), "task": F.when(has("task"), text("task")).when(v.isNotNull(), "classification"),
        "renamed": has("video_id") & ~has("id"), "task_added": ~has("task") & v.isNotNull()})


def normalized_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """(value): the JSON objects themselves with their video_id made the id and a missing task filled in; all other fields as they are.

    What isn't a JSON object is left as it is.
    """
    v = F.try_parse_json(line)
    keys = F.coalesce(F.json_object_keys(line), F.array().cast("array<string>"))
    rest = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: (k != "video_id") & ~((k == "id") & F.array_contains(keys, "video_id")))
    none = F.map_filter(F.create_map(F.lit(""), F.parse_json(F.lit("null"))), lambda k, _: k != "")
    ident = F.when(F.array_contains(keys, "video_id"), F.create_map(F.lit("id"), F.try_variant_get(v, "$.video_id", "variant"))).otherwise(none)
    task = F.when(~F.array_contains(keys, "task"), F.create_map(F.lit("task"), F.parse_json(F.lit('"classification"')))).otherwise(none)
    return df.select(F.coalesce(F.to_json(F.map_concat(ident, rest, task)), F.col(line)).alias("value"))


def having_key(df: DataFrame, key: str, line: str = "value") -> DataFrame:
    """The rows whose JSON object has ``key``, with null as its value too."""
    return df.where(F.array_contains(F.json_object_keys(line), key))


def change_counts(normalized: DataFrame, by: list[str]) -> DataFrame:
    return normalized.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if("renamed").alias("n_renamed"), F.count_if("task_added").alias("n_task_added"))


def image_paths(v: Column) -> Column:
    """The image list of a variant that is a list, one text, or nothing: a list in any case."""
    one = F.try_variant_get(v, "$", "string")
    return F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array_compact(F.array(one)))


def long_enough(video_meta: Column, least: int = 2) -> Column:
    """Keeps what isn't known to be shorter than ``least`` frames."""
    return F.coalesce(video_meta["nb_frames"] >= least, F.lit(True))


def source_counts(df: DataFrame, kept: Column, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_dropped"))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows of all sources, with source_id in the order given and source_name; missing columns are null. No source raises."""
    if not sources:
        raise ValueError("no source given")
    out = None
    for k, (name, df) in enumerate(sources.items()):
        tagged = df.withColumns({"source_id": F.lit(k), "source_name": F.lit(name)})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def resume(rows: DataFrame, done: DataFrame, key: str, retry_failed: bool = False, failed: str = "failed") -> DataFrame:
    """The rows that are still to do: those whose key no record of ``done`` has; null keys are always to do.

    A failed record counts as done unless ``retry_failed``.
    """
    records = done.where(~F.coalesce(F.col(failed), F.lit(False))) if retry_failed else done
    return rows.join(records.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def explode_channels(rows: DataFrame, parsed: str, channels: str, ident: str = "id") -> DataFrame:
    """One row per channel of a forecasting row: id ``{id}__ch{c}``, channel_index, channel_name, one-column targets.

    ``parsed``: the answer's rows (functions.forecast), ``channels``: names of the history's channels. A row whose
    answer can't be parsed, whose rows differ in width, or which has another number of channels raises.
    """
    p, c = F.col(parsed), F.col(channels)
    widths = F.array_distinct(F.transform(p, lambda r: F.size(r["values"])))
    right = p.isNotNull() & (F.size(widths) == 1) & (F.try_element_at(widths, F.lit(1)) == F.size(c))
    checked = F.when(F.coalesce(right, F.lit(False)), c).otherwise(F.raise_error(F.concat(F.lit("answer and channels don't match: "), F.coalesce(F.col(ident), F.lit("null")))))
    out = rows.select("*", F.posexplode(checked).alias("channel_index", "channel_name"))
    k = F.col("channel_index")
    return out.withColumns({
        ident: F.concat(F.col(ident), F.lit("__ch"), k.cast("string")),
        "target": F.transform(p, lambda r: F.struct(r["pos"].alias("pos"), r["label"].alias("label"), F.get(r["values"], k).alias("value")))})


def per_channel_rows(rows: DataFrame, channels: str, n_steps: str, folder: str = "") -> DataFrame:
    """Forecasting samples as one row per channel, with the paths and answer of that channel; all others unchanged.

    Adds to ``id`` ``__ch{c}``; timeseries_path and forecast_target_path are ``{folder}{id}__ch{c}.csv`` and
    ``.target.csv``, ts_shape is (n_steps, 1), answer the channel's own forecast block, with channel_index and
    channel_name. Fields that aren't named here pass through. ``channels`` and ``n_steps`` are the names of the history's
    channels and its steps. A forecasting row that doesn't fit (explode_channels) raises.
    """
    is_forecast = F.coalesce(F.col("task") == "prediction", F.lit(False))
    whole = rows.where(is_forecast).drop("channel_index", "channel_name")
    out = explode_channels(whole.withColumn("_parsed", parse_forecast(F.col("answer"))), "_parsed", channels)
    stem = F.concat(F.lit(folder), F.col("id"))
    out = out.withColumns({
        "timeseries_path": F.concat(stem, F.lit(".csv")), "forecast_target_path": F.concat(stem, F.lit(".target.csv")),
        "ts_shape": F.array(F.col(n_steps).cast("int"), F.lit(1)), "answer": forecast_text(F.col("_parsed"), F.col("channel_index"))})
    both = out.drop("_parsed", "target").unionByName(rows.where(~is_forecast), allowMissingColumns=True)
    return both.drop(channels, n_steps)


def channel_targets(rows: DataFrame, channels: str) -> DataFrame:
    """(id, step, channel_index, channel, value): the one-column target series of each channel of the forecasting rows."""
    some = rows.where("task = 'prediction'").drop("channel_index", "channel_name").withColumn("_parsed", parse_forecast(F.col("answer")))
    out = explode_channels(some, "_parsed", channels).select("id", "channel_name", F.explode("target").alias("t"))
    return out.select("id", F.col("t.pos").alias("step"), F.lit(0).alias("channel_index"), F.col("channel_name").alias("channel"), F.col("t.value").alias("value"))


def conversion_counts(before: DataFrame, after: DataFrame) -> tuple[int, int]:
    """Rows in and rows out."""
    return before.count(), after.count()


def series_stats(long: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mean, sigma) of a history: sigma is the root of the population variance plus 1e-6; null, NaN and infinite values are left out.

    A group whose values are all missing has mean 0 and sigma 1e-3.
    """
    v = F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.col(value))
    return long.groupBy(*by).agg(F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.sqrt(F.coalesce(F.var_pop(v), F.lit(0.0)) + 1e-6).alias("sigma"))


def znormalize(v: Column, mean: Column, sigma: Column) -> Column:
    return F.coalesce((v - F.coalesce(mean, F.lit(0.0))) / F.coalesce(sigma, F.lit(1.0)), v)


def denormalize(z: Column, mean: Column, sigma: Column) -> Column:
    return z * F.coalesce(sigma, F.lit(1.0)) + F.coalesce(mean, F.lit(0.0))


def masked_mse(df: DataFrame, by: list[str], truth: Column, predicted: Column, mask: Column) -> DataFrame:
    """Mean squared error over masked-in cells; 0 without any."""
    sq = F.when(mask, (truth - predicted) * (truth - predicted))
    return df.groupBy(*by).agg((F.coalesce(F.sum(sq), F.lit(0.0)) / F.greatest(F.lit(1), F.count(sq))).alias("loss"))
