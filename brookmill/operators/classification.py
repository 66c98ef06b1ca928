"""Scores of predicted labels: confusion matrix, per-class and overall measures, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LABELS = 10_000


def label_set(df: DataFrame, truth: str = "ground_truth", failed: str | None = "failed", blank: bool = True) -> list[str]:
    """Distinct non-null true labels of rows that didn't fail, in code-point order; without ``blank`` empty ones are out.

    At most MOST_LABELS, as the set goes to the driver and into expressions.
    """
    rows = df.where(F.col(truth).isNotNull())
    rows = rows.where(~F.coalesce(F.col(failed), F.lit(False))) if failed else rows
    rows = rows if blank else rows.where(F.col(truth) != "")
    found = [r[0] for r in rows.select(truth).distinct().limit(MOST_LABELS + 1).collect()]
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    return sorted(found)


def confusion(df: DataFrame, labels: list[str], by: list[str], truth: str = "gt", predicted: str = "pred") -> DataFrame:
    """(by, gt, pred, n): counts for every label and prediction, zeros too; a prediction out of the set counts as null.

    Rows whose true label is out of the set are not in the matrix.
    """
    some = labels or [""]
    counts = df.where(F.col(truth).isin(some)).groupBy(*by, F.col(truth).alias("gt"), F.when(F.col(predicted).isin(some), F.col(predicted)).alias("pred")).agg(F.count("*").alias("n"))
    cells = F.explode(F.array(*(F.lit(x) for x in labels))) if labels else F.explode(F.lit(None).cast("array<string>"))
    grid = df.select(*by).distinct().withColumn("gt", cells)
    grid = grid.withColumn("pred", F.explode(F.array(*(F.lit(x) for x in labels), F.lit(None).cast("string"))))
    same = [grid[b].eqNullSafe(counts[b]) for b in by] + [grid["gt"] == counts["gt"], grid["pred"].eqNullSafe(counts["pred"])]
    return grid.join(counts, same, "left").select(*(grid[b] for b in by), grid["gt"], grid["pred"], F.coalesce("n", F.lit(0)).alias("n"))


def _join_null_safe(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Inner join on ``by`` with null equal to null: a run without a name is a run too."""
    other = b.withColumnsRenamed({c: f"_{c}" for c in by})
    if not by:
        return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return a.join(other, [a[c].eqNullSafe(other[f"_{c}"]) for c in by]).drop(*(f"_{c}" for c in by))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_report(matrix: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, tp, fp, fn, support, precision, recall, f1) from a confusion matrix; ratios without a base are 0."""
    rows = matrix.where("gt = pred or pred is null or gt <> pred")
    of_gt = rows.groupBy(*by, F.col("gt").alias("label")).agg(F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("support"))
    of_pred = rows.where("pred is not null").groupBy(*by, F.col("pred").alias("label")).agg(F.sum("n").alias("guessed"))
    x = _join_null_safe(of_gt, of_pred, [*by, "label"])
    precision, recall = _ratio(F.col("tp"), F.col("guessed")), _ratio(F.col("tp"), F.col("support"))
    return x.select(
        *by, "label", "tp", (F.col("guessed") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), "support",
        precision.alias("precision"), recall.alias("recall"), _ratio(2 * precision * recall, precision + recall).alias("f1"))


def overall(df: DataFrame, report: DataFrame, labels: list[str], by: list[str], truth: str = "gt", predicted: str = "pred") -> DataFrame:
    """Per group total, correct, unparseable, unknown_gt, accuracy, macro_f1, weighted_f1 and uar.

    ``total`` has rows of unknown true labels too, and accuracy is over it; ``unparseable`` counts null predictions of
    known true labels only. Means of classes are over all labels given, unsupported ones included.
    """
    known = F.col(truth).isin(labels or [""])
    base = df.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(known & (F.col(truth) == F.col(predicted))).alias("correct"),
        F.count_if(known & F.col(predicted).isNull()).alias("unparseable"), F.count_if(~F.coalesce(known, F.lit(False))).alias("unknown_gt"))
    n = float(max(1, len(labels)))
    means = report.groupBy(*by).agg(
        (F.sum("f1") / n).alias("macro_f1"), _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), (F.sum("recall") / n).alias("uar"))
    return _join_null_safe(base, means, by).withColumn("accuracy", _ratio(F.col("correct"), F.greatest(F.lit(1), F.col("total"))))


def per_option(df: DataFrame, by: list[str], truth: str = "gt", predicted: str = "pred") -> DataFrame:
    """(by, gt, correct, total) with null equal to null; failed rows count too."""
    return df.groupBy(*by, truth).agg(F.count_if(F.col(truth).eqNullSafe(F.col(predicted))).alias("correct"), F.count("*").alias("total"))


def compare_runs(df: DataFrame, by: list[str], options: tuple[str, ...] = ("A", "B", "C"), truth: str = "gt", predicted: str = "pred") -> DataFrame:
    """One row per run: n, overall accuracy, accuracy on each option, and how often each option or none was predicted."""
    hit = F.col(truth).eqNullSafe(F.col(predicted))
    cols = [F.count("*").alias("n"), F.avg(hit.cast("double")).alias("overall")]
    for o in options:
        is_gt = F.col(truth) == o
        cols += [F.try_divide(F.count_if(is_gt & hit).cast("double"), F.count_if(is_gt).cast("double")).alias(f"acc_{o}"), F.count_if(F.col(predicted) == o).alias(f"pred_{o}")]
    return df.groupBy(*by).agg(*cols, F.count_if(F.col(predicted).isNull()).alias("pred_None"))


def inference_rollup(df: DataFrame, by: list[str], truth: str = "ground_truth", predicted: str = "prediction", failed: str = "failed") -> DataFrame:
    """Per run: rows, succeeded, failed, success rate, accuracy over all and over succeeded rows."""
    bad = F.coalesce(F.col(failed), F.lit(False))
    hit = ~bad & (F.col(truth) == F.col(predicted))
    return df.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("n_failed"), (F.count_if(~bad) / F.count("*")).alias("success_rate"),
        (F.count_if(hit) / F.count("*")).alias("accuracy"), F.coalesce(F.try_divide(F.count_if(hit).cast("double"), F.count_if(~bad).cast("double")), F.lit(0.0)).alias("accuracy_succeeded"))


def distribution(df: DataFrame, by: list[str], value: str, failed: str = "failed") -> DataFrame:
    """(by, bucket, n): rows by value, failed ones as ``_FAILED_``, null and empty values as ``_NONE_``."""
    bucket = F.when(F.coalesce(F.col(failed), F.lit(False)), "_FAILED_").when(F.coalesce(F.col(value), F.lit("")) == "", "_NONE_").otherwise(F.col(value))
    return df.groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def reparse_changes(df: DataFrame, new: Column, by: list[str], old: str = "prediction") -> DataFrame:
    """How many stored predictions a new parse would change, null-safe."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~new.eqNullSafe(F.col(old))).alias("n_changed"))


def detect_task(df: DataFrame, order: str, by: list[str], task: str = "task") -> DataFrame:
    """Per group the task of its first row if that has one, else the first non-empty one, else ``classification``."""
    some = F.when(F.col(task) != "", F.col(task))
    return df.groupBy(*by).agg(F.coalesce(F.min_by(some, order), F.min_by(some, F.when(some.isNotNull(), F.col(order))), F.lit("classification")).alias("task"))


def single_task(df: DataFrame, by: list[str], task: str = "task") -> DataFrame:
    """Per group its one distinct non-empty task, else ``classification``."""
    some = F.when(F.col(task) != "", F.col(task))
    return df.groupBy(*by).agg(F.when(F.count_distinct(some) == 1, F.min(some)).otherwise("classification").alias("task"))
