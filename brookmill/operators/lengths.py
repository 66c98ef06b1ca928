"""Sequence-length estimates from shapes and media headers, as column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LengthConfig:
    """Knobs of the estimate. The defaults are those of the project's data collators."""

    patch: int = 14
    temporal_patch: int = 2
    merge: int = 2
    video_min_pixels: int = 64 * 28 * 28
    video_max_pixels: int = 128 * 28 * 28
    image_min_pixels: int = 2 * 64 * 28 * 28
    image_max_pixels: int = 2 * 128 * 28 * 28
    sample_frames: bool = True
    fps: float = 1.0
    min_frames: int = 4
    max_frames: int = 80
    series_patch: int = 16
    strict: bool = False


def smart_resize(height: Column, width: Column, factor: int, low: int, high: int, strict: bool = False) -> tuple[Column, Column]:
    """(height, width) rounded half-even to multiples of ``factor`` and scaled into the pixel bounds; null unless both are positive.

    An aspect ratio over 200 gives null as well, or raises if ``strict``.
    """
    h, w = height.cast("double"), width.cast("double")
    if strict:
        h = F.when((h > 0) & (w > 0) & (F.greatest(h, w) > 200 * F.least(h, w)), F.raise_error(F.lit("aspect ratio over 200")).cast("double")).otherwise(h)
    ok = (h > 0) & (w > 0) & (F.greatest(h, w) <= 200 * F.least(h, w))
    rh, rw = F.rint(h / factor) * factor, F.rint(w / factor) * factor
    shrink = F.sqrt(F.try_divide(h * w, F.lit(float(high))))
    grow = F.sqrt(F.try_divide(F.lit(float(low)), h * w))

    def sized(x: Column, r: Column) -> Column:
        down = F.greatest(F.lit(float(factor)), F.floor(F.try_divide(F.try_divide(x, shrink), F.lit(float(factor)))).cast("double") * factor)
        up = F.ceil(x * grow / factor).cast("double") * factor
        return F.when(ok, F.when(rh * rw > high, down).when(rh * rw < low, up).otherwise(r)).cast("bigint")

    return sized(h, rh), sized(w, rw)


def sampled_frames(frames: Column, source_fps: Column, c: LengthConfig) -> Column:
    """Frames kept at the target rate: clipped, then floored to whole temporal patches, one patch at least."""
    t = float(c.temporal_patch)
    n = frames.cast("double")
    most = F.floor(F.least(F.lit(float(c.max_frames)), n) / t) * t
    wanted = F.try_divide(n, source_fps.cast("double")) * c.fps
    kept = F.floor(F.least(F.least(F.greatest(wanted, F.lit(float(c.min_frames))), most), n) / t) * t
    return F.when(n.isNull() | source_fps.isNull() | (n <= 0) | (source_fps <= 0), t).otherwise(F.greatest(kept, F.lit(t))).cast("bigint")


def video_tokens(meta: Column, c: LengthConfig = LengthConfig()) -> Column:
    """Visual tokens of a video from its header struct; 0 where the header is missing or has no positive size or frames."""
    n = meta["nb_frames"]
    t = c.temporal_patch
    frames = sampled_frames(n, F.coalesce(meta["source_fps"], F.lit(0.0)), c) if c.sample_frames else (F.ceil(n / F.lit(float(t))) * t).cast("bigint")
    h, w = smart_resize(meta["height"], meta["width"], c.patch * c.merge, c.video_min_pixels, c.video_max_pixels, c.strict)
    grid = F.floor(frames / t) * F.floor(h / c.patch) * F.floor(w / c.patch)
    return F.when(n > 0, F.coalesce(F.floor(grid / (c.merge * c.merge)), F.lit(0))).otherwise(0).cast("bigint")


def image_tokens(metas: Column, c: LengthConfig = LengthConfig()) -> Column:
    """Visual tokens of a list of image headers; malformed ones count nothing."""

    def one(m: Column) -> Column:
        h, w = smart_resize(m["height"], m["width"], c.patch * c.merge, c.image_min_pixels, c.image_max_pixels, c.strict)
        return F.coalesce(F.floor(F.floor(h / c.patch) * F.floor(w / c.patch) / (c.merge * c.merge)), F.lit(0)).cast("bigint")

    return F.coalesce(F.aggregate(metas, F.lit(0).cast("bigint"), lambda s, m: s + one(m)), F.lit(0).cast("bigint"))


def shape_known(shape: Column) -> Column:
    """A series shape counts if it is exactly (steps, channels), neither null nor negative."""
    return F.coalesce((F.size(shape) == 2) & (F.try_element_at(shape, F.lit(1)) >= 0) & (F.try_element_at(shape, F.lit(2)) >= 0), F.lit(False))


def series_tokens(shape: Column, c: LengthConfig = LengthConfig()) -> Column:
    """Patches times channels of a series; 0 where the shape isn't known."""
    patches = F.ceil(F.try_element_at(shape, F.lit(1)) / F.lit(float(c.series_patch)))
    return F.when(shape_known(shape), patches * F.try_element_at(shape, F.lit(2))).otherwise(0).cast("bigint")


def sequence_length(text_tokens: Column, video_path: Column, video_meta: Column, images: Column, image_meta: Column, shape: Column, c: LengthConfig = LengthConfig()) -> Column:
    """Tokens of a whole sample: a placeholder that the text counts is replaced by the tokens it stands for.

    One is taken off for a video and one for each image, not below 0, and one for a series, but only if its shape is known.
    """
    n = F.when(video_path.isNotNull(), F.greatest(F.lit(0), text_tokens - 1) + video_tokens(video_meta, c)).otherwise(text_tokens)
    n = F.when(images.isNotNull(), F.greatest(F.lit(0), n - F.size(images)) + image_tokens(image_meta, c)).otherwise(n)
    return F.when(shape_known(shape), n - 1 + series_tokens(shape, c)).otherwise(n).cast("bigint")


def length_summary(df: DataFrame, length: str, by: list[str]) -> DataFrame:
    """Per group n, min, p50 = the (n // 2)-th, p95 = the int(0.95 n)-th value counted from 0, max and mean.

    Exact order statistics without collecting a group: equal lengths are counted first, then only distinct lengths are
    ranked, so a window holds at most as many rows as there are different lengths.
    """
    counts = df.where(F.col(length).isNotNull()).groupBy(*by, length).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by).orderBy(length)
    whole = W.partitionBy(*by)
    c = counts.withColumn("_upto", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(whole))
    pick = lambda k: F.min(F.when(F.col("_upto") > k, F.col(length)))
    return c.groupBy(*by).agg(
        F.max("_all").alias("n"), F.min(length).alias("min_len"), pick(F.floor(F.col("_all") / 2)).alias("p50"),
        pick(F.floor(F.col("_all") * 0.95)).alias("p95"), F.max(length).alias("max_len"), (F.sum(F.col(length) * F.col("_n")) / F.max("_all")).alias("mean_len"))
