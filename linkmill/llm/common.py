"""Shared helpers: shared-folder tables, salted lookups, document columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local master may go without one and get a temporary folder."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("linkmill.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        path = "file://" + tempfile.mkdtemp(prefix="linkmill-")
        spark.conf.set("linkmill.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    return written(df, new_path(df.sparkSession, name))


class Scratch:
    """Tables in the shared folder that only the steps of one job read; they are removed as soon as none needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The table written and read back, until drop() or the end of the block."""
        self.paths[name] = new_path(self.spark, name)
        return written(df, self.paths[name])

    def give(self, df: DataFrame, name: str) -> DataFrame:
        """The table written and read back; it outlives the block, as the caller's result reads it."""
        return materialise(df, name)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for n in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(n))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()  # shuffle files go once the driver has forgotten their plans

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.paths)


_resident: dict = {}


def resident(key: tuple, make):
    """What a Python worker keeps between tasks, made once; asking for another key frees it.

    Workers serve later stages too: holding one operator's caches at a time bounds a worker's
    memory by the largest of them, not by their sum.
    """
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def salts(df: DataFrame) -> int:
    """Parts that a hot key is split into: one for each shuffle partition."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def salted_lookup(rows: DataFrame, table: DataFrame, key: str | list[str], spread: str) -> DataFrame:
    """Left join of `table` (unique in `key`) to `rows`, where one key may hold a third of all rows.

    Each key's rows are split by a hash of `spread`; the table meets only the distinct
    (key, part) pairs, and the rows are then joined on both columns.
    """
    n, key = salts(rows), [key] if isinstance(key, str) else key
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(spread), F.lit(n)).cast("int"))
    parts = dealt.groupBy(*key, "__part").agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    return dealt.join(parts.join(table, key), [*key, "__part"], "left").drop("__part")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
