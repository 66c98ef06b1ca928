"""Registered queries of the data-quality operators of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.operators.grid import OBSERVED, clip_series, regular_grid
from brookmill.operators.spikes import flag_spikes
from brookmill.session import table
from brookmill.sources.rejects import load_records, rejects


def p2_flags(spark: SparkSession, d: str) -> DataFrame:
    return flag_spikes(table(spark, d, "telemetry"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    # a level that changes in one step and stays is no case
    return p2_flags(spark, d).where("kind <> 'jump'").select("reading_id")


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    readings = table(spark, d, "telemetry").select("timeseries_path", "timestamp", "vEgo")
    return regular_grid(readings, clip_series(table(spark, d, "clips"), table(spark, d, "manifest")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_grid(spark, d).where(F.col("status") != OBSERVED).select("timeseries_path", "step")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects(table(spark, d, "raw_rows"))


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    return load_records(table(spark, d, "raw_rows")).where("reason is null").drop("reason")


QUERIES = {"p2_found": p2_found, "p2_flags": p2_flags, "p3_found": p3_found, "p3_grid": p3_grid, "p5_found": p5_found, "p5_loaded": p5_loaded}

SQL = {
    "p3_found": """
        with steps as (select timeseries_path, max(ts_shape[1]) as t from manifest where ts_shape is not null group by timeseries_path),
        grid as (select c.timeseries_path, started_at, step_ms, unnest(range(0, cast(t as bigint))) as step from clips c join steps using (timeseries_path)),
        seen as (
          select distinct c.timeseries_path, (epoch_us(r.timestamp) - epoch_us(c.started_at)) // (c.step_ms::bigint * 1000) as step
          from telemetry r join clips c using (timeseries_path)
          where r."vEgo" is not null and not isnan(r."vEgo") and r.timestamp >= c.started_at)
        select timeseries_path, step from grid where not exists (select 1 from seen where seen.timeseries_path = grid.timeseries_path and seen.step = grid.step)""",
}
