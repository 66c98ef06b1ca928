"""Series files: CSV with a header of its own in each file, read to long form, shapes without parsing, padding."""

from __future__ import annotations

import csv
import io
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.session import SharedTable
from brookmill.sources.manifest import replaced, safe_name

LONG = "path string, step int, channel_index int, channel string, value double"


#: What stands for a missing value in a series file. Fixed values.
MISSING = ["", "null", "nan", "NaN", "NULL", "NAN", "Null", "Nan"]


def parse_series(content: bytes) -> pa.Table:
    """(step, channel_index, channel, value) of a CSV file; a column named timestamp is left out, missing cells are null.

    Cells are read as texts, trimmed and cast by column; what is then no number raises, as does a line with too many
    cells. Short lines lack their last cells.
    """
    empty = pa.table({"step": pa.array([], pa.int32()), "channel_index": pa.array([], pa.int32()), "channel": pa.array([], pa.string()), "value": pa.array([], pa.float64())})
    head = next((x for x in content.decode("utf-8-sig").splitlines() if x.strip()), None)
    if head is None:
        return empty
    names = next(csv.reader([head]))
    width = len(names)

    odd: list[int] = []

    def invalid(row: pacsv.InvalidRow) -> str:
        odd.append(row.actual_columns)
        return "skip"

    def read(data: bytes) -> pa.Table:
        return pacsv.read_csv(
            io.BytesIO(data), read_options=pacsv.ReadOptions(use_threads=False, column_names=[str(k) for k in range(width)]), parse_options=pacsv.ParseOptions(invalid_row_handler=invalid),
            convert_options=pacsv.ConvertOptions(column_types={str(k): pa.string() for k in range(width)}, strings_can_be_null=False))

    found = read(content)
    if odd and max(odd) > width:
        raise ValueError(f"{max(odd)} cells under {width} names")
    if odd:
        padded = io.StringIO()
        csv.writer(padded, lineterminator="\n").writerows(r + [""] * (width - len(r)) for r in csv.reader(io.StringIO(content.decode("utf-8-sig"))) if r)
        found = read(padded.getvalue().encode())
    rows = found.slice(1)
    steps, parts = pa.array(np.arange(len(rows), dtype=np.int32)), []
    for c, k in enumerate(k for k, n in enumerate(names) if n != "timestamp"):
        cell = pc.utf8_trim_whitespace(rows.column(k))
        value = pc.cast(pc.if_else(pc.is_in(cell, value_set=pa.array(MISSING)), None, cell), pa.float64())
        parts.append(pa.table({"step": steps, "channel_index": pa.array(np.full(len(rows), c, dtype=np.int32)), "channel": pa.array([names[k]] * len(rows), pa.string()), "value": value}))
    return pa.concat_tables(parts) if parts else empty


def read_series(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Long form of series files: one file is one task's record, as each has a header of its own; bad numbers raise."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = parse_series(content)
                yield from rows.add_column(0, "path", pa.array([path] * len(rows), pa.string())).combine_chunks().to_batches()

    return files.mapInArrow(parse, LONG)


def series_csv(long: DataFrame, by: list[str], named: bool = True) -> DataFrame:
    """(by, csv): each series as the text of a CSV file, a line per step and a column per channel, missing values empty.

    ``long`` has step, channel_index, channel and value. A header of the channels' names comes first, unless not ``named``.
    """
    cell = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.col("value").cast("string")).otherwise("")
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("channel_index", cell.alias("c")))), lambda x: x["c"]), ",")
    steps = long.groupBy(*by, "step").agg(row.alias("r"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("channel_index", "channel"))), lambda x: x["channel"]), ",").alias("h"))
    text = steps.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "r"))), lambda x: x["r"]), "\n").alias("t"), F.min_by("h", "step").alias("h"))
    return text.select(*by, (F.concat("h", F.lit("\n"), "t", F.lit("\n")) if named else F.concat("t", F.lit("\n"))).alias("csv"))


def write_series(long: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Series in one Parquet table, partitioned by a hash of their key, in place only once all is written.

    Millions of files of a few kilobytes each would be slower to list than to read; export_series makes files.
    """
    bucketed = long.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    replaced(long.sparkSession, path, lambda to: bucketed.repartition(buckets, "bucket").sortWithinPartitions(key, "step").write.partitionBy("bucket").parquet(to))


def export_series(long: DataFrame, folder: str, key: str, suffix: str = ".csv") -> DataFrame:
    """Writes each series to a file of its own, ``folder/<key><suffix>``, from the tasks; gives (key, path, n_bytes).

    The folder must be one that all executors reach through their file system. A file is moved into place when complete.
    """
    name = series_csv(long, [key]).select(F.col(key).cast("string").alias("_key"), safe_name(F.col(key).cast("string")).alias("_name"), "csv")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            done = []
            for k, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                path = os.path.join(folder, n + suffix)
                part = f"{path}.{uuid.uuid4().hex}.tmp"
                with open(part, "w", encoding="utf-8", newline="") as f:
                    f.write(text)
                os.replace(part, path)
                done.append((k, path, len(text.encode())))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in done], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["key", "path", "n_bytes"])

    # written once, so that counting the result does not write the files again
    return SharedTable(name.mapInArrow(write, "key string, path string, n_bytes bigint"), "files").read()


def series_shape(text: Column) -> Column:
    """ARRAY<INT> (steps, channels) by counting lines and commas, no number parsed; null for an empty text.

    Blank lines count as steps, but for the end of the last line; columns named timestamp don't count as channels.
    """
    body = F.regexp_replace(text, r"\r?\n\z", "")
    lines = F.split(body, r"\r?\n", -1)
    channels = F.size(F.filter(F.split(F.try_element_at(lines, F.lit(1)), ",", -1), lambda c: F.btrim(c) != "timestamp"))
    return F.when(F.length(body) > 0, F.array((F.size(lines) - 1).cast("int"), channels.cast("int")))


def single_channel(long: DataFrame, by: list[str]) -> DataFrame:
    """Target series: what has another number of channels than one raises."""
    per = long.groupBy(*by).agg(F.countDistinct("channel_index").alias("_c"))
    marked = long.join(per, by)
    return marked.withColumn("value", F.when(F.col("_c") == 1, F.col("value")).otherwise(F.raise_error(F.lit("a target must have one channel")))).drop("_c")


def pad_series(long: DataFrame, by: list[str], batch: list[str]) -> DataFrame:
    """(by, channel_index, n_steps, n_channels, values): a channel's values padded with NaN to the longest of its batch."""
    arrays = long.groupBy(*batch, *by, "channel_index").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("_v"))
    sizes = long.groupBy(*batch, *by).agg((F.max("step") + 1).alias("n_steps"), F.countDistinct("channel_index").cast("int").alias("n_channels"))
    widest = long.groupBy(*batch).agg((F.max("step") + 1).alias("_width"))
    nan = F.lit(float("nan"))
    filled = F.transform("_v", lambda x: F.coalesce(x["value"], nan))
    joined = arrays.join(sizes, [*batch, *by])
    joined = joined.join(widest, batch) if batch else joined.withColumn("_width", F.lit(widest.first()["_width"]))
    return joined.select(*batch, *by, "channel_index", "n_steps", "n_channels", F.concat(filled, F.array_repeat(nan, F.col("_width") - F.size("_v"))).alias("values"))


def fraction(text: Column) -> Column:
    """A rate written ``num/den``, or as a number; 0 where the denominator is 0 or nothing can be read."""
    num, den = F.regexp_extract(text, r"^\s*([0-9.]+)\s*/", 1).try_cast("double"), F.regexp_extract(text, r"/\s*([0-9.]+)\s*$", 1).try_cast("double")
    return F.coalesce(F.when(text.contains("/"), F.try_divide(num, den)).otherwise(text.try_cast("double")), F.lit(0.0))


def complete_video_meta(frames: Column, duration: Column, fps: Column) -> Column:
    """STRUCT<nb_frames, duration>, either derived from the other where it is missing or not positive."""
    n = F.when((F.coalesce(frames, F.lit(0)) <= 0) & (duration > 0) & (fps > 0), F.floor(duration * fps).cast("int")).otherwise(frames)
    d = F.when((F.coalesce(duration, F.lit(0.0)) <= 0) & (n > 0) & (fps > 0), n / fps).otherwise(duration)
    return F.struct(n.alias("nb_frames"), d.alias("duration"))


def clip_times(first: Column, last: Column, fps: Column) -> Column:
    """STRUCT<start_sec, duration_sec> of a window of frames, both ends included; a rate of 0 or less gives null."""
    rate = F.when(fps > 0, fps)
    return F.struct((first / rate).alias("start_sec"), F.when(fps > 0, F.greatest(F.lit(1e-3), (last - first + 1) / rate)).alias("duration_sec"))


def frame_count(duration: Column, fps: Column, target: Column, low: int, high: int) -> Column:
    """Frames to take of a clip: the duration at the target rate, rounded half to even and clipped, 16 if unknown, no more than there are."""
    return F.coalesce(F.greatest(F.lit(low), F.least(F.lit(high), F.rint(duration * target).cast("int"))), F.lit(16))


def midpoints(total: Column, n: Column) -> Column:
    """``n`` places spread evenly: the middle of each segment, within 0..total-1."""
    seg = total.cast("double") / n
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.lit(0), F.least(total - 1, F.floor(seg * (i + 0.5)).cast("int"))))
