"""Run trees: finding runs and their metrics in folders, and the summary over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Measures shown by default for each task. Fixed values.
DEFAULTS = {"classification": ("accuracy", "macro_f1", "weighted_f1", "success_rate"), "prediction": ("mae", "mse", "mape", "pcc", "success_rate")}


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    """(ablation, dataset, task, metrics VARIANT) of every ``root/<ablation>/<dataset>/metrics.json``; a bad file has null metrics."""
    text = spark.read.text(f"{root.rstrip(chr(47))}/*/*/metrics.json", wholetext=True)
    path = F.split(F.col("_metadata.file_path"), "/")
    v = F.try_parse_json("value")
    task = F.coalesce(F.nullif(F.try_variant_get(v, "$.task", "string"), F.lit("")), F.lit("classification"))
    return text.select(F.try_element_at(path, F.lit(-3)).alias("ablation"), F.try_element_at(path, F.lit(-2)).alias("dataset"), task.alias("task"), v.alias("metrics"))


def metric(name: str, default: float | None = None, metrics: str = "metrics") -> Column:
    """One measure of a run's metrics, or ``default`` where the file or the key is missing or holds no number."""
    return F.coalesce(F.try_variant_get(metrics, f"$.{name}", "double"), F.lit(default).cast("double"))


def default_metrics(runs: DataFrame) -> DataFrame:
    """(dataset, task, metric, pos): the measures that each dataset shows by default, by its task (task_of_dataset)."""
    rows = [(t, m, k) for t, ms in DEFAULTS.items() for k, m in enumerate(ms)]
    shown_ = runs.sparkSession.createDataFrame(rows, "task string, metric string, pos int")
    kind = F.when(F.col("task") == "prediction", F.col("task")).otherwise("classification")
    return runs.select("dataset", kind.alias("task")).join(F.broadcast(shown_), "task").select("dataset", "task", "metric", "pos")


def named_sources(arguments: list[str]) -> dict[str, str]:
    """``name:path`` arguments, cut at the first colon; one without a colon, or without a name, raises."""
    found = {}
    for a in arguments:
        name, colon, path = a.partition(":")
        if not (name and colon and path):
            raise ValueError(f"{a} is not name:path")
        found[name] = path
    return found


def task_of_dataset(runs: DataFrame) -> DataFrame:
    """The task that the first run of a dataset, by name, has."""
    return runs.groupBy("dataset").agg(F.min_by("task", "ablation").alias("task"))


def with_sidecar(metrics: DataFrame, sidecar: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Metrics with what only the inference sidecar knows; a value that is there already stays."""
    side = sidecar.select(*by, *(F.col(k).alias(f"_{k}") for k in keys))
    joined = metrics.join(side, by, "left")
    return joined.withColumns({k: F.coalesce(F.col(k), F.col(f"_{k}")) if k in metrics.columns else F.col(f"_{k}") for k in keys}).drop(*(f"_{k}" for k in keys))


def effective_rate(task: Column, success: Column, parse: Column) -> Column:
    """A run's success rate: of predictions only what could also be parsed; null if either is missing."""
    return F.when(task == "prediction", success * parse).otherwise(success)


def long_metrics(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    return df.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names))).alias("x")).select(*by, "x.*")


def summary(long: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """One row per ablation and a column ``dataset/metric`` for each of ``columns``, holes null; more than 2000 columns raise."""
    if len(columns) > 2000:
        raise ValueError("too many columns for one table")
    named = long.withColumn("_c", F.concat_ws("/", "dataset", "metric"))
    return named.groupBy("ablation").pivot("_c", [f"{d}/{m}" for d, m in columns]).agg(F.first("v")).orderBy("ablation")


def shown(v: Column) -> Column:
    """A measure with four decimals; a missing one is empty."""
    return F.coalesce(F.format_string("%.4f", v), F.lit(""))


def report_lines(overall: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """A text report per group: one ``name: value`` line for each measure."""
    return overall.select(*by, F.concat_ws("\n", *(F.concat(F.lit(f"{n}: "), shown(F.col(n).cast("double"))) for n in names)).alias("report"))


def metrics_json(df: DataFrame, by: list[str]) -> DataFrame:
    """A group's measures as one JSON document, nulls written."""
    rest = [c for c in df.columns if c not in by]
    return df.select(*by, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("json"))
