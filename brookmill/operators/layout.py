"""Token layouts: interleaving series with video steps, three-dimensional positions, label masks, paddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def patch_step(patch: Column, n_patches: Column, n_steps: Column) -> Column:
    """The video step that a series patch lies in."""
    return F.least(n_steps - 1, F.floor(patch * n_steps / n_patches)).cast("int")


def interleave(n_steps: Column, per_step: Column, n_patches: Column, n_channels: Column) -> Column:
    """ARRAY<STRUCT<kind, at, sub>>: video tokens of each step, then the series patches that lie in it."""
    v = F.flatten(F.transform(F.sequence(F.lit(0), n_steps - 1), lambda t: F.transform(
        F.sequence(F.lit(0), per_step - 1), lambda s: F.struct(t.alias("step"), F.lit(0).alias("kind"), t.alias("at"), s.alias("sub")))))
    p = F.flatten(F.transform(F.sequence(F.lit(0), n_patches - 1), lambda i: F.transform(
        F.sequence(F.lit(0), n_channels - 1), lambda c: F.struct(patch_step(i, n_patches, n_steps).alias("step"), F.lit(1).alias("kind"), i.alias("at"), c.alias("sub")))))
    both = F.array_sort(F.concat(F.when((n_steps > 0) & (per_step > 0), v).otherwise(F.slice(v, 1, 0)), F.when((n_patches > 0) & (n_channels > 0), p).otherwise(F.slice(p, 1, 0))))
    return F.transform(both, lambda x: F.struct(F.when(x["kind"] == 0, "V").otherwise("T").alias("kind"), x["at"].alias("at"), x["sub"].alias("sub")))


def merge_by_time(df: DataFrame, by: list[str], at: str, kind: str, width: str) -> DataFrame:
    """Adds ``token_pos``, the place of an event's first token once events are merged by time; of equal times kind 0 first."""
    before = F.coalesce(F.sum(width).over(W.partitionBy(*by).orderBy(at, kind).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("token_pos", before)


def weave_tokens(ids: Column, video: int, series: int, start: int, end: int, n_steps: Column, per_step: Column, n_patches: Column, n_channels: Column) -> Column:
    """Token ids with the series moved to the video step each patch lies in, the markers around both.

    ``[prefix] V.. [mid] start T.. end [suffix]`` becomes ``[prefix] start V T V T .. end [mid] [suffix]``: as long as
    before. Samples without video or without series stay as they are; runs of another length than announced raise.
    """
    at_v, at_t = F.array_position(ids, video).cast("int"), F.array_position(ids, series).cast("int")
    n_v, n_t = n_steps * per_step, n_patches * n_channels
    counted = lambda t: F.size(F.filter(ids, lambda x: x == t))
    right = (counted(video) == n_v) & (counted(series) == n_t) & F.forall(F.slice(ids, at_v, n_v), lambda x: x == video) & F.forall(F.slice(ids, at_t, n_t), lambda x: x == series)
    body = F.transform(interleave(n_steps, per_step, n_patches, n_channels), lambda x: F.when(x["kind"] == "V", video).otherwise(series))
    rest = F.filter(F.slice(ids, at_v + n_v, F.size(ids)), lambda x: ~x.isin(series, start, end))
    woven = F.concat(F.slice(ids, F.lit(1), at_v - 1), F.array(F.lit(start)), body, F.array(F.lit(end)), rest)
    done = F.when(right & (F.size(woven) == F.size(ids)), woven).otherwise(F.raise_error(F.lit("runs of video or series tokens have another length than announced")))
    return F.when((at_v > 0) & (at_t > 0), done).otherwise(ids)


def last_header(ids: Column, header: list[int]) -> Column:
    """The place, from 1, of the header's last occurrence; null without one."""
    want = F.array(*(F.lit(x) for x in header))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ids) - len(header) + 1))
    return F.array_max(F.filter(starts, lambda i: F.slice(ids, i, len(header)) == want))


def mask_labels(ids: Column, header: list[int], end: int, valid: Column | None = None, ignore: int = -100) -> Column:
    """Token ids with everything but the last assistant turn and its end mark ignored; a sample without the header all."""
    begin = last_header(ids, header) + len(header)
    places = F.sequence(F.lit(1), F.size(ids))
    stop = F.coalesce(F.array_max(F.filter(places, lambda i: (i >= begin) & (F.get(ids, i - 1) == end))), F.size(ids))
    # a turn too short for any header is kept: there is nothing to mask
    keep = lambda i: F.when(F.size(ids) < len(header), True).otherwise(F.coalesce((i >= begin) & (i <= stop), F.lit(False)))
    shown = lambda i: keep(i) & (F.get(valid, i - 1) != 0) if valid is not None else keep(i)
    return F.transform(places, lambda i: F.when(shown(i), F.get(ids, i - 1)).otherwise(ignore))


def census(ids: Column, valid: Column, kinds: dict[str, int]) -> Column:
    """STRUCT of token counts by kind, all valid ones, and text: what is neither of the kinds."""
    counted = lambda t: F.size(F.filter(ids, lambda x: x == t))
    n = {k: counted(t) for k, t in kinds.items()}
    total = F.size(F.filter(valid, lambda x: x != 0))
    rest = total
    for c in n.values():
        rest = rest - c
    return F.struct(*(c.alias(k) for k, c in n.items()), total.alias("valid"), rest.alias("text"))


def pad_to(values: Column, width: Column, fill: Column, left: bool = False) -> Column:
    more = F.array_repeat(fill, F.greatest(F.lit(0), width - F.size(values)))
    return F.concat(more, values) if left else F.concat(values, more)


def pad_target(values: Column, pred_len: int) -> Column:
    """STRUCT<target padded with NaN, mask, len>; a target longer than ``pred_len`` raises."""
    n = F.size(values)
    padded = pad_to(values, F.lit(pred_len), F.lit(float("nan")))
    mask = F.transform(padded, lambda v, i: (i < n) & ~F.isnan(v))
    return F.when(n <= pred_len, F.struct(padded.alias("target"), mask.alias("mask"), n.alias("len"))).otherwise(F.raise_error(F.lit("target longer than the horizon")))


def group_ids(channels: Column) -> Column:
    """The sample's place repeated for each of its channels."""
    return F.flatten(F.transform(channels, lambda c, i: F.array_repeat(i, c)))


def time_first(n_channels: Column, n_patches: Column, n_padded: Column) -> Column:
    """Order in which channel-first padded patches are read time first, padding left out: places in the flat input."""
    return F.flatten(F.transform(F.sequence(F.lit(0), n_patches - 1), lambda p: F.transform(F.sequence(F.lit(0), n_channels - 1), lambda c: c * n_padded + p)))


def series_window(ids: Column, series: int, width: int) -> Column:
    """The ``width`` places from the first series token on; too few left raise, none gives null."""
    first = F.array_position(ids, series).cast("int")
    fits = first + width - 1 <= F.size(ids)
    return F.when(first > 0, F.when(fits, F.sequence(first - 1, first + width - 2)).otherwise(F.raise_error(F.lit("series window beyond the sequence"))))


def _span_positions(ids: np.ndarray, marks: dict[str, int], channels: int, grid: tuple[int, int, int] | None, seconds: float, merge: int, pps: float, vision: bool) -> tuple[np.ndarray, float]:
    """Positions of the tokens of one marked span, from 0 for its first marker, and the position after it."""
    n = len(ids)
    pos = np.zeros((3, n))
    inner_start = vision and n > 2 and ids[1] == marks["ts_start"]
    inner_end = vision and n > 2 and ids[-2] == marks["ts_end"]
    lead = 2 if inner_start else 1
    if inner_start:
        pos[:, 1] = 1
    low, high = lead, n - (2 if inner_end else 1)
    body = ids[low:high]
    place = np.full((3, len(body)), float(lead))
    series = body == marks["series"]
    if series.any():
        k = np.arange(int(series.sum()))
        video_too = vision and grid is not None and grid[0] > 0 and (ids == marks["video"]).any()
        patches = max(1, int((ids[1:-1] == marks["series"]).sum()) // channels)
        scale = grid[0] * seconds * pps / patches if video_too else 1.0
        place[:, series] += np.stack([(k // channels) * scale, k % channels, k % channels])
    seen = body == marks["video"] if vision else np.zeros(len(body), dtype=bool)
    if seen.any():
        k = np.arange(int(seen.sum()))
        h, w = (max(1, grid[1] // merge), max(1, grid[2] // merge)) if grid else (0, 0)
        step, inside = (k // (h * w), k % (h * w)) if grid else (k * 0, k * 0)
        place[:, seen] += np.stack([step * seconds * pps, inside // w if grid else k * 0, inside % w if grid else k * 0])
    pos[:, low:high] = place
    after = lead + (place.max() - lead if place.size else 0.0) + 1
    if inner_end:
        pos[:, n - 2] = after
        after += 1
    pos[:, n - 1] = after
    return pos, after + 1


def positions(ids: np.ndarray, marks: dict[str, int], channels: int, grids: list[tuple[int, int, int]], seconds: list[float], merge: int, pps: float) -> np.ndarray:
    """(3, n) positions of one sample's valid tokens: time, height and width.

    Marked spans are found first, then each is laid out on its own, and text between them counts one by one: a
    token's place is its place within its piece plus the length of the pieces before. An opening marker without its
    closing one is text. Series tokens have (patch, channel, channel), time scaled to the video's in a shared span.
    """
    ids = np.asarray(ids)
    out, base, at, used = np.zeros((3, len(ids))), 0.0, 0, 0
    opens = np.flatnonzero((ids == marks["vision_start"]) | (ids == marks["ts_start"]))
    ends = {m: np.flatnonzero(ids == marks[m]) for m in ("vision_end", "ts_end")}
    for i in opens:
        if i < at:
            continue  # inside a span that is done
        vision = ids[i] == marks["vision_start"]
        close = ends["vision_end" if vision else "ts_end"]
        k = np.searchsorted(close, i + 1)
        if k == len(close):
            continue
        j = int(close[k])
        out[:, at:i] = base + np.arange(i - at)
        base += i - at
        grid = tuple(int(x) for x in grids[used]) if vision and used < len(grids) else None
        pace = float(seconds[used]) if vision and grid is not None and used < len(seconds) else 1.0
        place, length = _span_positions(ids[i : j + 1], marks, max(1, channels), grid, pace, merge, pps, vision)
        out[:, i : j + 1] = base + place
        base, at, used = base + length, j + 1, used + vision
    out[:, at:] = base + np.arange(len(ids) - at)
    return out


def rope_positions(df: DataFrame, ids: str, channels: str, grids: str, seconds: str, marks: dict[str, int], merge: int = 2, pps: float = 25.0, valid: str | None = None) -> DataFrame:
    """Adds ``positions`` ARRAY<ARRAY<INT>> (time, height, width, cut to whole numbers; 1 on padding) and ``delta``."""
    schema = "struct<positions:array<array<int>>,delta:int>"

    @F.pandas_udf(schema)
    def place(i: pd.Series, c: pd.Series, g: pd.Series, s: pd.Series, v: pd.Series) -> pd.DataFrame:
        rows = []
        for a, n, grid, pace, ok in zip(i, c, g, s, v):
            a = np.asarray(a)
            mask = np.ones(len(a), dtype=bool) if ok is None else np.asarray(ok) != 0
            p = np.ones((3, len(a)))
            p[:, mask] = positions(a[mask], marks, int(n), [tuple(x) for x in grid] if grid is not None else [], list(pace) if pace is not None else [], merge, pps)
            most = p[:, mask].max() if mask.any() else -1.0
            rows.append((p.astype(int).tolist(), int(most) + 1 - len(a) if mask.any() else 0))
        return pd.DataFrame(rows, columns=["positions", "delta"])

    mask = F.col(valid) if valid else F.lit(None).cast("array<int>")
    return df.withColumn("_p", place(F.col(ids), F.col(channels), F.col(grids), F.col(seconds), mask)).select("*", "_p.positions", "_p.delta").drop("_p")
