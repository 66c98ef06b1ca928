"""Reading and writing sample manifests and prediction records as JSON lines."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VIDEO_META = "struct<width:int,height:int,source_fps:double,nb_frames:int,duration:double>"
IMAGE_META = "struct<width:int,height:int,channels:int,mode:string>"
#: Fields of a sample and how each is read from its JSON value; texts that may be a list are made one.
FIELDS = {
    "id": "string", "task": "string", "prompt": "string", "answer": "string", "video_path": "string", "timeseries_path": "string", "forecast_target_path": "string",
    "video_meta": VIDEO_META, "ts_shape": "array<int>", "channel_index": "int", "channel_name": "string",
}
SAMPLE = ("id", "task", "video_path", "image_path", "timeseries_path", "forecast_target_path", "prompt", "answer")
PREDICTION = "id string, ground_truth string, prediction string, raw string, failed boolean, error string, traceback string"


def typed_samples(lines: DataFrame, value: str = "value") -> DataFrame:
    """Sample rows from JSON objects in a text column: declared fields typed, image lists made lists, all others in ``extra``.

    ``extra`` is a JSON object of the fields that aren't declared, values as they were, ``extra_keys`` their names; both
    are null without any. Fields of another type than declared are null. Other columns are kept.
    """
    v = F.try_parse_json(value)
    df = lines.withColumn("_v", v)
    one_image = F.try_variant_get("_v", "$.image_path", "string")
    cols = {k: F.try_variant_get("_v", f"$.{k}", t) for k, t in FIELDS.items()}
    cols["image_path"] = F.coalesce(F.try_variant_get("_v", "$.image_path", "array<string>"), F.array_compact(F.array(one_image)))
    cols["image_meta"] = F.coalesce(F.try_variant_get("_v", "$.image_meta", f"array<{IMAGE_META}>"), F.array_compact(F.array(F.try_variant_get("_v", "$.image_meta", IMAGE_META))))
    keys = F.array_except(F.coalesce(F.json_object_keys(value), F.array()), F.array(*(F.lit(k) for k in (*FIELDS, "image_path", "image_meta"))))
    some = F.size(keys) > 0
    rest = F.map_filter(F.try_variant_get("_v", "$", "map<string,variant>"), lambda k, _: F.array_contains(keys, k))
    return df.withColumns({**cols, "extra_keys": F.when(some, F.array_join(keys, ",")), "extra": F.when(some, F.to_json(rest))}).drop("_v")


def sample_lines(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(value): one JSON object a sample, its declared fields that aren't null and then those of ``extra``, nothing escaped that needn't be."""
    names = fields or [c for c in (*FIELDS, "image_path", "image_meta") if c in df.columns]
    line = F.to_json(F.struct(*names))
    if "extra" in df.columns:
        inner = F.regexp_replace(F.col("extra"), r"^\s*\{|\}\s*$", "")
        line = F.when(F.btrim(inner) == "", line).when(inner.isNotNull(), F.concat(F.regexp_replace(line, r"\}$", ""), F.when(line == "{}", "").otherwise(","), inner, F.lit("}"))).otherwise(line)
    return df.select(line.alias("value"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no BIGINT): the lines of a file, or of each file of a folder, numbered from 1.

    A split of a file is one run of rows of one task. Where it begins, and how many lines the splits before it have, is
    counted first: one row a split, however large the file is.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    splits = lines.groupBy("_f", "_b").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_f").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_f", "_b", "_first", before.alias("_before"))
    return lines.join(splits, ["_f", "_b"]).select("value", (F.col("_before") + F.col("_m") - F.col("_first") + 1).alias("line_no"))


def first_lines(df: DataFrame, n: int | None) -> DataFrame:
    """The rows of the first ``n`` lines, the same ones every time; all without ``n``."""
    return df if n is None else df.where(F.col("line_no") <= n)


def read_samples(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """JSON-line samples of one or more files, with source_id, source_name, line_no and the file's own line text.

    Blank lines are skipped. A line that isn't a JSON object raises if ``strict``, else it is left out. The source's
    name is the file name up to its first dot; sources keep the order given. An empty list raises.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no path given")
    parts = []
    for k, path in enumerate(paths):
        lines = numbered_lines(spark, path).where(F.btrim("value", F.lit(" \t\r\n")) != "")
        name = os.path.basename(path.rstrip("/")).split(".")[0]
        parts.append(lines.withColumns({"source_id": F.lit(k), "source_name": F.lit(name)}))
    lines = reduce(DataFrame.unionByName, parts)
    good = F.try_parse_json("value").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{"))
    if strict:
        lines = lines.withColumn("value", F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80)))))
    else:
        lines = lines.where(good)
    return typed_samples(lines)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Records of a prediction file, undecodable lines left out; a missing file has none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], PREDICTION)
    parsed = F.from_json("value", PREDICTION + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = spark.read.text(path).where(F.btrim("value", F.lit(" \t\r\n")) != "")
    return lines.select(parsed.alias("x")).where("x is not null and x._bad is null").select("x.*").drop("_bad")


def _move(spark: SparkSession, a: str, b: str) -> None:
    p, q = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (a, b))
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(p, q):
        raise OSError(f"{a} could not be moved to {b}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Has ``write`` fill a staging folder and puts it in the place of ``path``, which ``write`` may read.

    The old folder is moved aside, not deleted, until the new one is in place: after a crash in between, ``path.old`` has
    it, and the next call puts it back first. A write that fails leaves ``path`` as it was and no staging folder.
    """
    target = path.rstrip("/")
    staging, aside = f"{target}.{uuid.uuid4().hex}.tmp", f"{target}.old"
    if _exists(spark, aside):
        if not _exists(spark, target):
            _move(spark, aside, target)
        else:
            _delete(spark, aside)
    try:
        write(staging)
    except BaseException:
        _delete(spark, staging)
        raise
    if _exists(spark, target):
        _move(spark, target, aside)
    _move(spark, staging, target)
    _delete(spark, aside)


def write_json_atomically(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines in ``path``, in place only once all are written; with ``order`` sorted by it over all files."""
    rows = df.orderBy(*order) if order else df
    replaced(df.sparkSession, path, lambda to: rows.write.option("ignoreNullFields", "false").json(to))


def write_samples(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Samples as JSON lines with all their fields (sample_lines), replaced as a whole; with ``order`` sorted by it."""
    lines = sample_lines(df.orderBy(*order) if order else df)
    replaced(df.sparkSession, path, lines.write.text)


def append_once(df: DataFrame, path: str, chunk: str) -> None:
    """Writes a chunk of finished records; the same chunk again replaces itself, so a retry repeats nothing."""
    df.write.mode("overwrite").json(f"{path.rstrip('/')}/chunk={chunk}")


def dataset_file(names: list[str], name: str, variants: tuple[str, ...] = ("percha",), suffix: str = ".jsonl") -> str:
    """Of the files of a folder the one for a dataset: the untagged one, else the first one with a tag, else the untagged name.

    A tag is one part between dots that is no variant.
    """
    if name + suffix in names:
        return name + suffix
    tagged = sorted(n for n in names if (m := re.fullmatch(re.escape(name) + r"\.([^.]+)" + re.escape(suffix), n)) and m[1] not in variants)
    return tagged[0] if tagged else name + suffix


def dataset_stem(path: str, variants: tuple[str, ...] = ("percha",), suffix: str = ".jsonl") -> str:
    """A dataset file's name without folder, suffix and tag; a variant is kept."""
    stem = os.path.basename(path).removesuffix(suffix)
    head, dot, tag = stem.rpartition(".")
    return head if dot and tag not in variants else stem


def derived_path(path: str, added: str = ".percha", suffix: str = ".jsonl") -> str:
    """A sibling of ``path`` with ``added`` before its tag."""
    folder, base = os.path.split(path)
    head, dot, rest = base.removesuffix(suffix).partition(".")
    return os.path.join(folder, f"{head}{added}{dot}{rest}{suffix}")


def safe_name(text):  # noqa: ANN001, ANN201
    """A column's text as a folder name: every other character becomes an underscore."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_")
