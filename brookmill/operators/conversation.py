"""Samples as conversations: typed content in order, ablations, prompt transforms, series markers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marker texts of a series in a templated prompt. Fixed values.
TS_START, TS_PLACEHOLDER, TS_END = "<|ts_start|>", "<|ts_placeholder|>", "<|ts_end|>"
ELEMENT = "struct<type:string,value:string>"


def _element(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"))


def build_conversation(
    prompt: Column, answer: Column, video: Column, images: Column, series: Column, task: Column, vision: Column | bool = True, timeseries: Column | bool = False,
    transform: Callable[[Column], Column] | None = None, skip_tasks: tuple[str, ...] = (),
) -> Column:
    """ARRAY<STRUCT<role, content ARRAY<STRUCT<type, value>>>>: video, images, series, text; then the answer if there is one.

    Without ``vision`` neither video nor images appear. ``transform`` is applied to prompts but for ``skip_tasks``.
    """
    as_col = lambda x: F.lit(x) if isinstance(x, bool) else x
    text = prompt
    if transform:
        text = F.when(F.coalesce(task.isin(*skip_tasks), F.lit(False)), prompt).otherwise(transform(prompt)) if skip_tasks else transform(prompt)
    none = F.expr(f"cast(array() as array<{ELEMENT}>)")
    seen = F.when(as_col(vision) & (video != ""), F.array(_element("video", video))).otherwise(none)
    stills = F.when(as_col(vision) & images.isNotNull(), F.transform(images, lambda p: _element("image", p))).otherwise(none)
    read = F.when(as_col(timeseries), F.array(_element("timeseries", series))).otherwise(none)
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    user = turn("user", F.concat(seen, stills, read, F.array(_element("text", text))))
    return F.when(answer.isNull(), F.array(user)).otherwise(F.array(user, turn("assistant", F.array(_element("text", answer)))))


def mark_series(conversation: Column) -> Column:
    """Series elements turned into text elements with the marker."""
    marker = F.lit(TS_START + TS_PLACEHOLDER + TS_END)
    return F.transform(conversation, lambda m: F.struct(m["role"].alias("role"), F.transform(
        m["content"], lambda e: F.when(e["type"] == "timeseries", _element("text", marker)).otherwise(e)).alias("content")))


def expand_placeholder(text: Column, n: Column) -> Column:
    """The first placeholder repeated ``n`` times; a text without one raises."""
    at = F.instr(text, TS_PLACEHOLDER)
    size = len(TS_PLACEHOLDER)
    grown = F.concat(F.substr(text, F.lit(1), at - 1), F.repeat(F.lit(TS_PLACEHOLDER), n.cast("int")), F.substr(text, at + size))
    return F.when(at > 0, grown).otherwise(F.raise_error(F.lit("no series placeholder in the text")))


#: Which inputs each ablation leaves: name, vision, series. Fixed values.
ABLATIONS = (("full", True, True), ("no_vision", False, True), ("no_timeseries", True, False))


def ablate(df: DataFrame) -> DataFrame:
    """Every row once for each ablation, with ``ablation``, ``use_vision`` and ``use_series``."""
    kinds = F.array(*(F.struct(F.lit(n).alias("ablation"), F.lit(v).alias("use_vision"), F.lit(s).alias("use_series")) for n, v, s in ABLATIONS))
    return df.select("*", F.inline(kinds))


def cap_images(images: Column, n_video_frames: Column, most: int = 50) -> Column:
    """The images that still fit beside a video's frames, from the front."""
    return F.slice(images, F.lit(1), F.greatest(F.lit(0), F.lit(most) - n_video_frames))
