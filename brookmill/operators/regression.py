"""Errors of aligned forecasts: per row inside the row's arrays, then means of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def finite_pairs(rows: Column, channel: Column) -> Column:
    """(g, p) of one channel of aligned rows where both are finite."""
    pairs = F.transform(rows, lambda r: F.struct(F.get(r["g"], channel).alias("g"), F.get(r["p"], channel).alias("p")))
    return F.filter(pairs, lambda x: _finite(x["g"]) & _finite(x["p"]))


def _sum(xs: Column, f) -> Column:  # noqa: ANN001
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))


def _mean(xs: Column, f) -> Column:  # noqa: ANN001
    return F.try_divide(_sum(xs, f), F.size(xs).cast("double"))


def errors(pairs: Column) -> Column:
    """STRUCT<n, mae, mse, mape, mape_skipped>; the errors are null without a pair, mape also without a pair of g off zero.

    mape is in percent and leaves out, and counts, pairs with abs(g) under EPS.
    """
    off = F.filter(pairs, lambda x: F.abs(x["g"]) >= EPS)
    return F.struct(
        F.size(pairs).alias("n"), _mean(pairs, lambda x: F.abs(x["g"] - x["p"])).alias("mae"),
        _mean(pairs, lambda x: (x["g"] - x["p"]) * (x["g"] - x["p"])).alias("mse"),
        (_mean(off, lambda x: F.abs(x["g"] - x["p"]) / F.abs(x["g"])) * 100).alias("mape"), (F.size(pairs) - F.size(off)).alias("mape_skipped"))


def pcc(pairs: Column) -> Column:
    """Pearson's correlation, two-pass; null under two pairs or where a side is constant."""
    mg, mp = _mean(pairs, lambda x: x["g"]), _mean(pairs, lambda x: x["p"])
    cov = _sum(pairs, lambda x: (x["g"] - mg) * (x["p"] - mp))
    vg, vp = _sum(pairs, lambda x: (x["g"] - mg) * (x["g"] - mg)), _sum(pairs, lambda x: (x["p"] - mp) * (x["p"] - mp))
    g, p = F.transform(pairs, lambda x: x["g"]), F.transform(pairs, lambda x: x["p"])
    varies = (F.size(pairs) >= 2) & (F.array_min(g) < F.array_max(g)) & (F.array_min(p) < F.array_max(p))
    return F.when(varies, F.try_divide(cov, F.sqrt(vg) * F.sqrt(vp)))


def score_rows(aligned: DataFrame, column: str = "aligned") -> DataFrame:
    """Adds ``score`` (errors over all channels and pcc, their mean) and ``channels`` (the same for each) to aligned rows."""
    a = F.col(column)
    per = F.transform(F.sequence(F.lit(0), a["width"] - 1), lambda c: finite_pairs(a["rows"], c))
    df = aligned.withColumn("_pairs", F.when(a.isNotNull() & (a["width"] > 0), per))
    df = df.withColumn("channels", F.transform("_pairs", lambda x: F.struct(errors(x).alias("e"), pcc(x).alias("pcc"))))
    df = df.withColumn("_all", errors(F.flatten("_pairs")))
    known = F.filter(F.transform("channels", lambda c: c["pcc"]), lambda v: v.isNotNull())
    return df.withColumn("score", F.struct("_all.*", _mean(known, lambda v: v).alias("pcc"))).drop("_pairs", "_all")


def dataset_scores(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per group: rows, parsed rows, alignments, and the means over rows of the rows' errors (never pooled over elements).

    Rows whose error is undefined don't enter its mean; skipped mape cells add up all the same.
    """
    s, a = F.col("score"), F.col("aligned")
    done = a.isNotNull() & (F.size(a["rows"]) > 0)
    return scored.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(done).alias("succeeded"), F.count_if(~F.coalesce(done, F.lit(False))).alias("n_failed"),
        (F.count_if(done) / F.count("*")).alias("parse_rate"), F.count_if(a["length_mismatch"]).alias("length_mismatch_count"),
        F.count_if(a["alignment"] == "by_label").alias("n_by_label"), F.count_if(a["alignment"] == "positional").alias("n_positional"),
        F.avg(s["mae"]).alias("mae"), F.avg(s["mse"]).alias("mse"), F.avg(s["mape"]).alias("mape"),
        F.coalesce(F.sum(F.when(done, s["mape_skipped"])), F.lit(0)).cast("bigint").alias("mape_skipped"), F.avg(s["pcc"]).alias("pcc"), F.max(a["width"]).alias("channels"))


def channel_scores(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per group and channel the means over the rows that have the channel; every channel up to the widest row is there."""
    return scored.select(*by, F.posexplode("channels").alias("channel", "c")).groupBy(*by, "channel").agg(
        F.count_if(F.col("c.e.n") > 0).alias("n_rows"), F.avg("c.e.mae").alias("mae"), F.avg("c.e.mse").alias("mse"), F.avg("c.e.mape").alias("mape"))
