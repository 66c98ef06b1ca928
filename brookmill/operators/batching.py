"""Batches under a padded-token budget, the same task at every step of every rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brookmill.operators.normalize import resume
from brookmill.operators.ordinals import ordinals, uniform
from brookmill.session import SharedTable


def greedy_batches(sorted_items: Column, max_tokens: int, max_bs: int) -> Column:
    """(item, batch, pos) for items ascending by ``len``: a batch takes the next one while its padded size allows.

    The padded size is the longest length times the number of items; an item over the budget is a batch of its own.
    """
    start = F.struct(F.lit(-1).alias("b"), F.lit(0).alias("n"), F.expr("cast(array() as array<struct<item:bigint,len:bigint,batch:int,pos:int>>)").alias("out"))

    def add(s: Column, x: Column) -> Column:
        fits = (s["n"] > 0) & (x["len"] * (s["n"] + 1) <= max_tokens) & (s["n"] < max_bs)
        b, n = F.when(fits, s["b"]).otherwise(s["b"] + 1), F.when(fits, s["n"]).otherwise(0)
        row = F.struct(x["item"].cast("bigint").alias("item"), x["len"].cast("bigint").alias("len"), b.alias("batch"), n.alias("pos"))
        return F.struct(b.alias("b"), (n + 1).alias("n"), F.concat(s["out"], F.array(row)).alias("out"))

    return F.aggregate(sorted_items, start, add, lambda s: s["out"])


def plan_batches(df: DataFrame, item: str, length: str, task: str, max_tokens: int, max_bs: int = 8, bucket_size: int = 200, seed: int = 42, epoch: int = 0, key: Column | None = None) -> DataFrame:
    """(task, bucket, batch, pos, item, len): every item once, in batches of one task within the budget.

    Items are shuffled by a hash of seed, epoch and item (or by ``key``, values in [0, 1)), cut into buckets of
    ``bucket_size``, sorted by length in a bucket and packed greedily. Null lengths count as 0. Only a bucket, whose
    size is fixed, is ever an array. A null task is a task of its own.
    """
    if max_tokens <= 0:
        raise ValueError("max_tokens must be over 0")
    order = key if key is not None else uniform(F.lit(seed + epoch), F.col(item))
    rows = df.select(F.col(item).cast("bigint").alias("item"), F.coalesce(F.col(length).cast("bigint"), F.lit(0)).alias("len"), F.col(task).alias("task"), order.alias("_order"))
    placed = ordinals(rows, "_at", ["task"], F.col("_order"), ["item"]).withColumn("bucket", F.floor(F.col("_at") / bucket_size))
    chunks = placed.groupBy("task", "bucket").agg(F.array_sort(F.collect_list(F.struct("len", F.col("_at").alias("at"), "item"))).alias("_items"))
    return chunks.select("task", "bucket", F.explode(greedy_batches(F.col("_items"), max_tokens, max_bs)).alias("x")).select(
        "task", "bucket", "x.batch", "x.pos", "x.item", "x.len")


def plan_steps(batches: DataFrame, world: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Adds ``step`` and ``rank``: at every step all ranks have batches of one task, and all ranks as many.

    Batches of a task are shuffled and grouped by ``world``; a task's last incomplete group is dropped (fewer than
    ``world`` batches a task); groups are shuffled over tasks. The batches are written once, as they are read again and again.
    """
    world = max(1, world)
    batches = SharedTable(batches, "batches").read()
    heads = batches.where("pos = 0").select("task", "bucket", "batch")
    placed = ordinals(heads, "_at", ["task"], uniform(F.lit(seed + epoch), F.lit("batch"), "task", "bucket", "batch"), ["bucket", "batch"])
    whole = placed.withColumn("_block", F.floor(F.col("_at") / world)).withColumn("_n", F.count("*").over(W.partitionBy("task", "_block"))).where(F.col("_n") == world)
    whole = SharedTable(whole.drop("_n"), "steps").read()
    blocks = ordinals(whole.select("task", "_block").distinct(), "step", [], uniform(F.lit(seed + epoch), F.lit("block"), "task", "_block"), ["task", "_block"])
    steps = whole.join(blocks.withColumnsRenamed({"task": "_t", "_block": "_b"}), F.col("task").eqNullSafe(F.col("_t")) & (F.col("_block") == F.col("_b")))
    steps = steps.select(F.col("task").alias("_t"), F.col("bucket").alias("_u"), F.col("batch").alias("_c"), "step", (F.col("_at") % world).cast("int").alias("rank"))
    return batches.join(steps, F.col("task").eqNullSafe(F.col("_t")) & (F.col("bucket") == F.col("_u")) & (F.col("batch") == F.col("_c"))).drop("_t", "_u", "_c")


def shard(df: DataFrame, ordinal: str, world: int, truncate_to: Column | None = None) -> DataFrame:
    """Adds ``rank`` and ``turn`` by striding over an ordinal; with ``truncate_to``, the number of rows, ranks get as many."""
    kept = df.where(F.col(ordinal) < F.floor(truncate_to / world) * world) if truncate_to is not None else df
    return kept.withColumns({"rank": (F.col(ordinal) % world).cast("int"), "turn": F.floor(F.col(ordinal) / world)})


def plan_remaining(rows: DataFrame, done: DataFrame, key: str, item: str, length: str, task: str, max_tokens: int, retry_failed: bool = False, **plan: int) -> DataFrame:
    """plan_batches of the rows that no record of ``done`` has finished (normalize.resume): a resumed run packs what is left."""
    return plan_batches(resume(rows, done, key, retry_failed), item, length, task, max_tokens, **plan)
