"""Laying a parsed forecast over its ground truth: by label where all labels are there, else by position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_width(values: Column, width: Column) -> Column:
    """Padded with nulls or cut to ``width``."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(None).cast("double"), width)), F.lit(1), width)


def align_forecast(truth: Column, predicted: Column) -> Column:
    """STRUCT of both sides' rows at the width of the widest true row, and how they were aligned; null if a side is null.

    ``by_label`` if every true label is predicted: true rows in their order, each beside the last predicted row of its
    label. Else ``positional``: rows side by side, as many as the shorter side has. ``missing_labels`` counts true rows
    whose label is not predicted.
    """
    width = F.array_max(F.transform(truth, lambda r: F.size(r["values"])))
    backwards = F.reverse(predicted)
    found = lambda r: F.try_element_at(F.filter(backwards, lambda p: p["label"] == r["label"]), F.lit(1))["values"]
    missing = F.size(F.filter(truth, lambda r: ~F.exists(predicted, lambda p: p["label"] == r["label"])))
    n = F.least(F.size(truth), F.size(predicted))
    by_label = F.transform(truth, lambda r: F.struct(to_width(r["values"], width).alias("g"), to_width(found(r), width).alias("p")))
    by_place = F.transform(F.slice(truth, F.lit(1), n), lambda r, i: F.struct(to_width(r["values"], width).alias("g"), to_width(F.get(predicted, i)["values"], width).alias("p")))
    info = F.struct(
        F.when(missing == 0, by_label).otherwise(by_place).alias("rows"), width.alias("width"),
        F.when(missing == 0, "by_label").otherwise("positional").alias("alignment"), missing.alias("missing_labels"),
        (F.size(truth) != F.size(predicted)).alias("length_mismatch"), F.size(truth).alias("len_gt"), F.size(predicted).alias("len_pred"))
    return F.when(truth.isNotNull() & predicted.isNotNull(), info)
