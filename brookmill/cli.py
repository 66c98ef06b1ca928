"""Commands over files: ``normalize`` rewrites sample files, ``channels`` makes forecasting samples one row per channel."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.functions.forecast import parse_forecast
from brookmill.operators import normalize as N
from brookmill.sources.manifest import FIELDS, derived_path, numbered_lines, read_samples, replaced, write_samples
from brookmill.sources.series import export_series, read_series


def normalize(spark: SparkSession, path: str, out: str) -> dict[str, int]:
    """Rewrites one file as the folder ``out``, lines in their order, and counts what changed; ``out`` may be ``path``."""
    lines = numbered_lines(spark, path).where(F.btrim("value", F.lit(" \t\r\n")) != "")
    counts = N.change_counts(N.normalize_rows(lines, "value"), []).first()
    changed = N.normalized_lines(lines.orderBy("line_no"))
    replaced(spark, out, changed.write.text)
    return counts.asDict()


def channels(spark: SparkSession, path: str, out: str, series_folder: str) -> tuple[int, int]:
    """Forecasting samples of ``path`` by channel as ``out``, with a history and a target file for each in ``series_folder``.

    Histories are read from the samples' timeseries_path. Gives the rows in and out.
    """
    samples = read_samples(spark, path)
    wanted = samples.where("task = 'prediction' and timeseries_path is not null").select("timeseries_path").distinct()
    files = [r[0] for r in wanted.collect()]  # paths to open, one a sample
    long = read_series(spark, files) if files else None
    if long is None:
        rows = samples.withColumns({"_names": F.lit(None).cast("array<string>"), "_steps": F.lit(0)})
    else:
        long = long.withColumn("_path", F.regexp_replace("path", "^file:/*", "/"))
        of = long.groupBy("_path").agg(F.array_sort(F.collect_set(F.struct("channel_index", "channel"))).alias("_c"), (F.max("step") + 1).alias("_steps"))
        of = of.select("_path", F.transform("_c", lambda c: c["channel"]).alias("_names"), "_steps")
        rows = samples.join(of, samples["timeseries_path"] == of["_path"], "left").drop("_path")
    rows = rows.withColumn("_history", F.col("timeseries_path"))
    folder = series_folder.rstrip("/") + "/"
    by_channel = N.per_channel_rows(rows, "_names", "_steps", folder)
    if long is not None:
        ids = by_channel.where("channel_index is not null and task = 'prediction'").select("id", "channel_index", F.col("_history").alias("_path"))
        history = long.join(ids, ["_path", "channel_index"]).select("id", "step", F.lit(0).alias("channel_index"), "channel", "value")
        export_series(history, series_folder, "id")
        export_series(N.channel_targets(rows, "_names"), series_folder, "id", ".target.csv")
    write_samples(by_channel.drop("_history"), out, ["line_no", "channel_index"])
    return samples.count(), read_samples(spark, out).count()


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="brookmill")
    sub = p.add_subparsers(dest="command", required=True)
    n = sub.add_parser("normalize")
    n.add_argument("--in", dest="paths", action="append", required=True)
    where = n.add_mutually_exclusive_group(required=True)
    where.add_argument("--inplace", action="store_true")
    where.add_argument("--out-dir")
    c = sub.add_parser("channels")
    c.add_argument("--in", dest="path", required=True)
    c.add_argument("--out")
    c.add_argument("--series-dir", required=True)
    a = p.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "normalize":
        for path in a.paths:
            out = path if a.inplace else os.path.join(a.out_dir, os.path.basename(path))
            print(path, normalize(spark, path, out))
    else:
        print(a.path, *channels(spark, a.path, a.out or derived_path(a.path), a.series_dir))


if __name__ == "__main__":
    main()
