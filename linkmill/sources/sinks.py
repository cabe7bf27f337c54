"""Sinks: committed parts with resume, checked publishing with metrics, many subsets in one scan, bucketed columns, batches of alike lengths."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .tables import StaleArtifact, read_json, write_json


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def moved(spark: SparkSession, stage: str, path: str) -> None:
    """A finished folder put in its place by one rename; what stood there goes first."""
    files, at = _files(spark, path)
    files.mkdirs(at(path).getParent())
    files.delete(at(path), True)
    if not files.rename(at(stage), at(path)):
        raise OSError(f"{stage} could not be moved to {path}")


def folder_name(part: str) -> str:
    """A part's name in letters that every file system takes as they are."""
    return "p-" + quote(part, safe="").replace("_", "%5F").replace("~", "%7E").replace("%", "_")


def committed_parts(spark: SparkSession, path: str, key: str, parts: Iterable[str], make: Callable[[str], DataFrame], mark: str) -> DataFrame:
    """The rows of make(part) for every part, with `key`; parts that an earlier run has committed under the same mark are not made again.

    A part is written beside its place, moved there by one rename, and then marked; without its mark it does not
    count and is made anew. A part marked with another `mark` is refused.
    """
    parts = list(parts)
    files, at = _files(spark, path)
    for part in parts:
        name = folder_name(part)
        note = f"{path}/marks/{name}.json"
        if files.exists(at(note)):
            if read_json(spark, note)["mark"] != mark:
                raise StaleArtifact(f"{path}: {part} was made from other inputs")
            continue
        stage = f"{path}/_staging/{uuid.uuid4().hex}"
        make(part).drop(key).write.parquet(stage)
        moved(spark, stage, f"{path}/rows/{name}")
        write_json(spark, note, {"mark": mark, "part": part})
    # a folder of its own for each part: a name is never read as a pattern or a partition
    got = [spark.read.parquet(f"{path}/rows/{folder_name(p)}").withColumn(key, F.lit(p)) for p in parts]
    return reduce(DataFrame.unionByName, got)


def publish(df: DataFrame, path: str, metrics: dict[str, Column], checks: dict[str, Callable], log: str | None = None) -> dict:
    """df written to `path` if its metrics, gathered in the same pass, satisfy the checks; otherwise nothing at `path` changes.

    metrics: name -> aggregate; checks: name -> predicate of its value. log: folder that gets a record of each run, published or not.
    """
    spark, seen, stage = df.sparkSession, Observation(), f"{path}-staging-{uuid.uuid4().hex}"
    df.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.parquet(stage)
    got = dict(seen.get)
    failed = sorted(n for n, holds in checks.items() if not holds(got[n]))
    if log:
        write_json(spark, f"{log}/{time.time_ns()}-{uuid.uuid4().hex}.json", {"path": path, "metrics": got, "failed": failed})
    if failed:
        files, at = _files(spark, stage)
        files.delete(at(stage), True)
        raise ValueError(f"{path} is not published: {', '.join(f'{n} = {got[n]}' for n in failed)}")
    moved(spark, stage, path)
    return got


def write_subsets(df: DataFrame, masks: dict[str, Column], path: str) -> None:
    """Each row written to every subset whose mask takes it, in one scan; NULL masks take none. subset(spark, path, name) reads one."""
    named = F.array_compact(F.array(*[F.when(m, F.lit(n)) for n, m in masks.items()]))
    df.withColumn("subset", F.explode(named)).write.mode("overwrite").partitionBy("subset").parquet(path)


def subset(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One subset: only its folder is read."""
    return spark.read.parquet(path).filter(F.col("subset") == name).drop("subset")


def store_columns(df: DataFrame, table: str, keys: tuple[str, ...] = ("ri", "si"), buckets: int = 64) -> None:
    """Feature columns as a table bucketed and sorted by key: tables of the same keys and buckets join without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def stored_columns(spark: SparkSession, tables: list[str], keys: tuple[str, ...] = ("ri", "si")) -> DataFrame:
    """The columns of all tables side by side, for the keys that each has."""
    return reduce(lambda a, b: a.join(b.hint("merge"), list(keys)), [spark.table(t) for t in tables])


def where(df: DataFrame, predicate: str) -> DataFrame:
    """The rows that a predicate given as text takes; an error that names the columns if it does not fit the table."""
    if not predicate.strip():
        return df
    try:
        out = df.filter(predicate)
        out.schema  # resolves the columns
        return out
    except AnalysisException as e:
        raise ValueError(f"{predicate!r} does not fit the columns {df.columns}") from e


def length_batches(df: DataFrame, text: str, budget: int) -> DataFrame:
    """df with batch (a number): rows of alike lengths, a batch's longest times its rows at most `budget` (a longer row is one by itself)."""
    def run(batches):
        part = None
        number, n, longest = 0, 0, 0
        for b in batches:
            if part is None:
                from pyspark import TaskContext

                part = TaskContext.get().partitionId() << 40
            size = b.column(b.num_columns - 1).to_numpy()
            out = np.empty(b.num_rows, np.int64)
            for i, s in enumerate(size.tolist()):
                longest = max(longest, s)
                if n and longest * (n + 1) > budget:
                    number, n, longest = number + 1, 0, s
                n += 1
                out[i] = part + number
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], [*b.schema.names[:-1], "batch"])

    sized = df.withColumn("__size", F.coalesce(F.length(text), F.lit(0)).cast("long")).repartitionByRange("__size").sortWithinPartitions("__size")
    return sized.mapInArrow(run, df.drop("batch").schema.add("batch", "long"))
