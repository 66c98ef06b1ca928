"""Session helpers: shared tables that cut lineage, table scans, skew-safe joins."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_MADE: list[SharedFolder] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Where the setting is absent and the master is a plain ``local[...]`` one, a temporary folder is made for this
    process and removed at its end. On a cluster without the setting this raises: a machine-local folder would lose
    data with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="brookmill-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return f"file://{_LOCAL[app]}"


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Plans that run within this are cut into methods that the JVM compiles.

    It only ever interprets methods of more than 8000 bytes, while Spark fuses a stage into methods of up to 65535.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class SharedFolder:
    """A path of its own in the shared folder, removed by release."""

    def __init__(self, spark: SparkSession, name: str = "t"):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/brookmill-{name}-{uuid.uuid4().hex}"
        _MADE.append(self)

    def drop(self) -> None:
        """Removes the files. Only call this when no lazy result still reads them."""
        if self in _MADE:
            _MADE.remove(self)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class SharedTable(SharedFolder):
    """A Parquet table in the shared folder, standing in for a lineage that should be cut.

    Unlike ``localCheckpoint`` it survives the loss of any executor, and it is columnar and compressed.
    """

    def __init__(self, df: DataFrame, name: str = "t"):
        super().__init__(df.sparkSession, name)
        self.schema = df.schema
        with compiled(self.spark):
            df.write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def release() -> None:
    """Removes all shared tables made so far; results that are lazily read from them must be done with."""
    while _MADE:
        _MADE.pop().drop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Keys of at least this many rows are joined by broadcast in join_hot; fewer than total / HOT_ROWS of them can exist.
HOT_ROWS = 50_000


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int, most: int = 10_000, keep: bool = False) -> DataFrame:
    """Inner join of many ``rows`` with one ``keyed`` row per key, holding up where a key has a third of all rows.

    ``keyed`` has column ``n``: how many of ``rows`` have the key. Hot keys, those of at least HOT_ROWS rows and of at
    least ``total / most`` rows, are at most ``most`` many, so they are broadcast; rows of other keys are shuffled,
    where no key can exceed the bound. Nothing is dropped. A null key matches nothing. ``keep`` keeps ``n``.
    """
    least = max(HOT_ROWS, total // most)
    rest = keyed.where(F.col(n) < least)
    hot = keyed.where(F.col(n) >= least)
    if not keep:
        keyed, rest, hot = keyed.drop(n), rest.drop(n), hot.drop(n)
    if total < HOT_ROWS:
        return rows.join(keyed, key)
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
    return (
        marked.where(F.col("_hot")).drop("_hot").join(F.broadcast(hot), key)
        .unionByName(marked.where(F.col("_hot").isNull()).drop("_hot").join(rest, key))
    )
