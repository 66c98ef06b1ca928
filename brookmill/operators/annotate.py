"""Annotations of samples: what is still to probe, what can be used, what must be set aside, and lengths kept for later."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.operators.conversation import cap_images
from brookmill.operators.lengths import LengthConfig
from brookmill.sources.manifest import replaced


def todo(video_meta: Column, series_path: Column, shape: Column, force: bool = False) -> Column:
    """STRUCT<video, series>: whether a sample's media still need probing; a sample without a series has none to probe."""
    always = F.lit(force)
    return F.struct((always | video_meta.isNull()).alias("video"), ((F.coalesce(series_path, F.lit("")) != "") & (always | shape.isNull())).alias("series"))


def coverage(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("video_meta").isNotNull()).alias("n_video_meta"), F.count_if(F.col("ts_shape").isNotNull()).alias("n_ts_shape"))


def usable_meta(video_path: Column, video_meta: Column, images: Column, image_meta: Column, shape: Column) -> Column:
    """STRUCT<video, images, series>: whether cached headers can stand in for a probe.

    A video's needs its size, rate and frames; the images' must be as many as there are paths; a shape has two numbers.
    """
    video = (video_path != "") & video_meta["width"].isNotNull() & video_meta["height"].isNotNull() & video_meta["source_fps"].isNotNull() & video_meta["nb_frames"].isNotNull()
    stills = (F.size(images) > 0) & (F.size(image_meta) == F.size(images))
    no = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(no(video).alias("video"), no(stills).alias("images"), no(F.size(shape) == 2).alias("series"))


def why_not(task: Column, series_path: Column, target_path: Column, target_len: Column | None = None, horizon: int = 0) -> Column:
    """Why a sample can't enter a forecasting batch: the first of task, series, target and length; null if it can."""
    long = target_len > horizon if target_len is not None else F.lit(False)
    return (
        F.when(~F.coalesce(task == "prediction", F.lit(False)), "task").when(series_path.isNull(), "series").when(target_path.isNull(), "target").when(long, "length"))


def square_tags(prompt: Column) -> Column:
    """Video tags in a prompt written with square brackets, so that no scorer takes them for placeholders."""
    return F.replace(F.replace(prompt, F.lit("<video>"), F.lit("[video]")), F.lit("</video>"), F.lit("[/video]"))


def request_frames(meta: Column, n_images: Column, fps: float = 1.0, low: int = 4, high: int = 80, most: int = 50) -> Column:
    """Frames of a video that a request of at most ``most`` pictures takes beside ``n_images`` images, one at least."""
    seconds = F.when(meta["duration"] > 0, meta["duration"]).otherwise(F.coalesce(F.try_divide(meta["nb_frames"], meta["source_fps"]), F.lit(0.0)))
    wanted = F.greatest(F.lit(1), F.rint(seconds * fps).cast("int"))
    return F.greatest(F.lit(low), F.least(F.least(F.lit(high), F.greatest(F.lit(1), F.lit(most) - n_images)), wanted))


def capped_size(width: Column, height: Column, most_pixels: int) -> Column:
    """STRUCT<width, height> scaled down, sides cut to whole pixels, where there are more than ``most_pixels``."""
    scale = F.sqrt(F.try_divide(F.lit(float(most_pixels)), width.cast("double") * height))
    over = width.cast("bigint") * height > most_pixels
    side = lambda x: F.when(over, F.greatest(F.lit(1), F.floor(x * scale).cast("int"))).otherwise(x)
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def request_parts(prompt: Column, images: Column, n_frames: Column, most: int = 50) -> Column:
    """ARRAY<STRUCT<type, value>> of a request: the text, a video's frames by number, then the images that still fit."""
    part = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.cast("string").alias("value"))
    frames = F.when(n_frames > 0, F.transform(F.sequence(F.lit(0), n_frames - 1), lambda i: part("frame", i))).otherwise(F.expr("cast(array() as array<struct<type:string,value:string>>)"))
    stills = F.transform(F.coalesce(cap_images(images, n_frames, most), F.expr("cast(array() as array<string>)")), lambda p: part("image", p))
    return F.concat(F.array(part("text", prompt)), frames, stills)


def length_key(config: LengthConfig, *more: Column) -> Column:
    """Identifies what a length depends on: all knobs and, as ``more``, the content it was computed from."""
    knobs = ";".join(f"{k}={v}" for k, v in sorted(asdict(config).items()))
    return F.sha2(F.concat_ws("\x01", F.lit(knobs), *(F.coalesce(c.cast("string"), F.lit("\x02")) for c in more)), 256)


def with_cached_lengths(rows: DataFrame, key: Column, compute: Column, cached: DataFrame | None, name: str = "length") -> DataFrame:
    """``rows`` with ``length_key`` and their length, from ``cached`` (length_key, name) where the key is there, else computed."""
    keyed = rows.withColumn("length_key", key)
    if cached is None:
        return keyed.withColumn(name, compute)
    old = cached.select("length_key", F.col(name).alias("_cached")).dropDuplicates(["length_key"])
    return keyed.join(old, "length_key", "left").withColumn(name, F.coalesce("_cached", compute)).drop("_cached")


def save_lengths(df: DataFrame, path: str, name: str = "length") -> None:
    """Lengths by their key, and how many rows they were computed for, in place only once both are written."""
    n = df.count()
    kept = df.select("length_key", name).dropDuplicates(["length_key"]).withColumn("n_rows", F.lit(n).cast("bigint"))
    replaced(df.sparkSession, path, kept.write.parquet)


def load_lengths(spark: SparkSession, path: str, n_rows: int | None = None) -> DataFrame | None:
    """What save_lengths kept; None where nothing is kept or, with ``n_rows``, it was kept for another number of rows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    kept = spark.read.parquet(path)
    if n_rows is not None and kept.where(F.col("n_rows") != n_rows).limit(1).count():
        return None
    return kept.drop("n_rows")


def assert_same_rows(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raises unless both have the same keys: lengths must belong to the rows they are used with."""
    left, right = a.join(b, key, "left_anti").limit(1).count(), b.join(a, key, "left_anti").limit(1).count()
    if left or right or a.count() != b.count():
        raise ValueError("rows and lengths have drifted apart")
