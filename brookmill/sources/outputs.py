"""What an evaluation delivers: metric documents, text reports, tables, predictions with what is known about their run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brookmill.operators.classification import inference_rollup
from brookmill.sources.manifest import replaced, write_json_atomically

#: Measures of a classification, of a forecast and of one class, in the order they are written. Fixed values.
CLASS_MEASURES = ("total", "correct", "unparseable", "unknown_gt", "accuracy", "macro_f1", "weighted_f1", "uar")
FORECAST_MEASURES = ("total", "succeeded", "n_failed", "parse_rate", "mae", "mse", "mape", "pcc")
#: Keys that only the run itself knows; they are taken over where the metrics lack them. Fixed values.
FROM_RUN = ("succeeded", "failed", "success_rate")
MOST_CHANNELS = 100_000


def _listed(rows: DataFrame, by: list[str], key: list[Column], value: Column, name: str) -> DataFrame:
    """One row a group with its rows' ``value`` in the order of ``key``. What is listed here are classes, their pairs or channels."""
    order = F.array_sort(F.collect_list(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(key)), value.alias("v"))))
    return rows.groupBy(*by).agg(F.transform(order, lambda x: x["v"]).alias(name))


def _joined(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    other = b.withColumnsRenamed({c: f"_{c}" for c in by})
    return a.join(other, [a[c].eqNullSafe(other[f"_{c}"]) for c in by], "left").drop(*(f"_{c}" for c in by))


def class_documents(overall: DataFrame, report: DataFrame, matrix: DataFrame, by: list[str]) -> DataFrame:
    """(by, json): a run's classification measures, by class and as a confusion matrix whose missing prediction is ``None``."""
    per = _listed(report, by, [F.col("label")], F.struct("label", F.struct("precision", "recall", "f1", "support").alias("m")), "_per")
    cells = matrix.select(*by, "gt", F.coalesce("pred", F.lit("None")).alias("pred"), "n", F.col("pred").isNull().alias("last"))
    rows = _listed(cells, [*by, "gt"], [F.col("last"), F.col("pred")], F.struct("pred", "n"), "_row")
    grid = _listed(rows, by, [F.col("gt")], F.struct("gt", F.col("_row").alias("r")), "_grid")
    all_ = _joined(_joined(overall, per, by), grid, by)
    body = F.struct(*(F.col(c) for c in CLASS_MEASURES), F.map_from_entries("_per").alias("per_class"), F.map_from_entries(F.transform("_grid", lambda g: F.struct(g["gt"], F.map_from_entries(g["r"])))).alias("confusion_matrix"), F.transform("_per", lambda x: x["label"]).alias("labels"))
    return all_.select(*by, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def with_run(documents: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """Metric documents with what is known about their run (by, json) as ``infer``; its counts stand in for missing ones."""
    known = F.json_object_keys("json")
    inner = lambda c: F.regexp_replace(c, r"^\s*\{|\}\s*$", "")
    value = lambda k: F.try_variant_get(F.try_parse_json("_about"), f"$.{k}", "string")
    more = F.array_compact(F.array(*(F.when(~F.array_contains(known, k) & value(k).isNotNull(), F.concat(F.lit(f'"{k}":'), value(k))) for k in FROM_RUN)))
    joined = _joined(documents, runs.withColumnRenamed("json", "_about"), by)
    text = F.concat(F.lit("{"), F.array_join(F.concat(F.array(inner(F.col("json")), F.concat(F.lit('"infer":'), F.col("_about"))), more), ","), F.lit("}"))
    return joined.select(*by, F.coalesce(F.when(F.col("_about").isNotNull(), text), F.col("json")).alias("json"))


def class_text(overall: DataFrame, report: DataFrame, matrix: DataFrame, by: list[str]) -> DataFrame:
    """(by, report): counts and measures, a line per class, then the confusion matrix, its last column without a prediction."""
    f = F.format_string
    head = F.concat_ws("\n",
        f("n=%d  correct=%d  unparseable=%d  unknown_gt=%d", "total", "correct", "unparseable", "unknown_gt"),
        *(f(f"{name:<12}: %.4f{more}", c) for name, c, more in (("Accuracy", "accuracy", ""), ("Macro F1", "macro_f1", ""), ("Weighted F1", "weighted_f1", ""), ("UAR", "uar", "  (= macro-averaged recall)"))),
        F.lit(""), f("%8s %10s %10s %10s %10s", F.lit("class"), F.lit("precision"), F.lit("recall"), F.lit("f1"), F.lit("support")))
    per = _listed(report, by, [F.col("label")], f("%8s %10.4f %10.4f %10.4f %10d", "label", "precision", "recall", "f1", "support"), "_per")
    row = _listed(matrix, [*by, "gt"], [F.col("pred").isNull(), F.col("pred")], f("%7d", "n"), "_n")
    rows = _listed(row, by, [F.col("gt")], F.concat(f("%10s", "gt"), F.array_join("_n", "")), "_rows")
    names = F.array_join(F.transform("_names", lambda c: F.lpad(c, F.greatest(F.lit(7), F.length(c)), " ")), "")
    labels = _listed(report, by, [F.col("label")], F.col("label"), "_names")
    all_ = _joined(_joined(_joined(overall, per, by), rows, by), labels, by)
    return all_.select(*by, F.concat_ws("\n", head, F.array_join("_per", "\n"), F.lit(""), F.lit("Confusion matrix (rows=gt, cols=pred; trailing col = unparseable):"),
        F.concat(f("%10s", F.lit("gt/pred")), names, f("%7s", F.lit("None"))), F.array_join("_rows", "\n")).alias("report"))


def forecast_text_report(scores: DataFrame, channels: DataFrame, by: list[str]) -> DataFrame:
    """(by, report): counts and errors of a forecasting run, then a line per channel. A missing measure is ``nan``."""
    def number(c: str, how: str) -> Column:
        width = how[1 : how.index(".")]
        return F.when(F.col(c).isNull(), "nan".rjust(int(width or 0))).otherwise(F.format_string(how, F.col(c).cast("double")))

    head = F.concat_ws("\n", F.concat(F.format_string("n=%d  succeeded=%d  failed=%d  parse_rate=", "total", "succeeded", "n_failed"), number("parse_rate", "%.4f")), F.lit(""),
        *(F.concat(F.lit(f"{n:<4} : "), number(n.lower(), how), F.lit(more)) for n, how, more in (("MAE", "%.6f", ""), ("MSE", "%.6f", ""), ("MAPE", "%.4f", "%"), ("PCC", "%.6f", ""))))
    line = F.concat(F.format_string("%4d ", "channel"), number("mae", "%12.6f"), F.lit(" "), number("mse", "%12.6f"), F.lit(" "), number("mape", "%12.4f"))
    per = _listed(channels.where(F.col("channel") < MOST_CHANNELS), by, [F.col("channel")], line, "_per")
    table = F.when(F.size("_per") > 0, F.concat_ws("\n", F.lit(""), F.lit("Per-channel:"), F.format_string("%4s %12s %12s %12s", F.lit("ch"), F.lit("MAE"), F.lit("MSE"), F.lit("MAPE(%)")), F.array_join("_per", "\n")))
    return _joined(scores, per, by).select(*by, F.concat_ws("\n", head, table).alias("report"))


def aligned(df: DataFrame, columns: list[str], order: list[str], digits: int = 4) -> DataFrame:
    """(line_no, line): a table for reading, each column as wide as the longest name and two more; numbers with a fixed count of decimals."""
    wide = max(map(len, columns)) + 2
    kinds = dict(df.dtypes)
    cell = lambda c: F.when(F.col(c).isNull(), "None").otherwise(F.format_string(f"%.{digits}f", c) if kinds[c] in ("double", "float") else F.col(c).cast("string"))
    pad = lambda x: F.rpad(x, F.greatest(F.lit(wide), F.length(x)), " ")
    head = df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("line_no"), F.lit("  ".join(c.ljust(wide) for c in columns)).alias("line"))
    # a comparison has one row a run
    rows = df.select(F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)).cast("bigint").alias("line_no"), F.concat_ws("  ", *(pad(cell(c)) for c in columns)).alias("line"))
    return head.unionByName(rows)


def write_csv(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header in the folder ``path``, in place only once written; null is empty."""
    replaced(df.sparkSession, path, lambda to: df.coalesce(1).write.option("header", True).option("emptyValue", "").csv(to))


def write_documents(documents: DataFrame, root: str, by: list[str], column: str = "json", name: str = "metrics") -> None:
    """One text per run under ``root/<name>``, in folders ``by=value``; the whole tree is replaced at once."""
    replaced(documents.sparkSession, f"{root.rstrip('/')}/{name}", lambda to: documents.select(*by, F.col(column).alias("value")).repartition(*by).write.partitionBy(*by).text(to))


def write_predictions(results: DataFrame, path: str, about: dict[str, str | int | bool | None], extra: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Predictions as JSON lines in ``path`` and, in ``path.metrics``, one JSON line on the run: ``about`` and its counts."""
    write_json_atomically(results, path)
    counts = inference_rollup(results, []) if extra is None else extra(results)
    known = [(F.lit(v) if v is not None else F.lit(None).cast("string")).alias(k) for k, v in about.items()]
    write_json_atomically(counts.withColumnRenamed("n_failed", "failed").select(*known, "*"), f"{path.rstrip('/')}.metrics")


def write_debug_rows(scored: DataFrame, path: str) -> None:
    """What each row's score was made of, a JSON line each."""
    write_json_atomically(scored, path)
