"""Dense ordinals over a whole group without sorting the group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def uniform(*cols: Column | str) -> Column:
    """A number in (0, 1) by hashing ``cols``."""
    return (F.pmod(F.xxhash64(*cols), F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float((1 << 52) - 1))


def ordinals(df: DataFrame, name: str, by: list[str], key: Column, ties: list[str], places: int = 1024) -> DataFrame:
    """Adds ``name``: the row's rank from 0 within ``by``, ordered by ``key``, a value in [0, 1), then by ``ties``.

    Keys fall into ``places`` ranges. A range is sorted on its own and starts where the counts of the ranges before it
    end; those counts, at most ``places`` a group, are all that is summed over a whole group. With a key that is even
    over the group, such as a hash, no task gets more than a share of a group, however large the group is.
    """
    place = F.least(F.floor(key * places), F.lit(places - 1)).cast("int")
    placed = df.withColumns({"_key": key, "_place": place})
    group = by or ["_all"]
    placed = placed if by else placed.withColumn("_all", F.lit(0))
    counts = placed.groupBy(*group, "_place").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*(F.col(g).alias(f"_{g}") for g in group), F.col("_place").alias("_at"), before.alias("_before"))
    same = [placed[g].eqNullSafe(starts[f"_{g}"]) for g in group] + [placed["_place"] == starts["_at"]]
    within = F.row_number().over(W.partitionBy(*group, "_place").orderBy("_key", *ties)) - 1
    return placed.join(starts, same).withColumn(name, (F.col("_before") + within).cast("bigint")).select(*df.columns, name)
