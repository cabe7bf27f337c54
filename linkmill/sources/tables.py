"""Tab-separated sources, ground truth, id-list sink, aligned tables and fingerprints."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["entity_id", "business_name", "business_address", "country"]


def quoted_after(line: str, inside: bool, sep: str = "\t", quote: str = '"') -> bool:
    """Whether a quoted field is open at the end of a line that began with one open or not. Only a field that begins with the quote is quoted; a doubled quote inside one is a letter."""
    at, n = 0, len(line)
    while True:
        if not inside:
            while not line.startswith(quote, at):  # on to the next field
                at = line.find(sep, at) + 1
                if not at:
                    return False
            at += 1
        inside = True
        while True:
            at = line.find(quote, at)
            if at < 0:
                return True
            if line.startswith(quote, at + 1):
                at += 2
                continue
            break
        at = line.find(sep, at + 1) + 1
        inside = False
        if not at or at > n:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split (where it starts), i (in order within a split), line."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("line"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, n (of the record in its file, from 0), record: the text of each record, whose quoted fields may hold line breaks.

    One large file is read by many tasks. A split does not know whether it begins inside a quoted field, so
    it is looked at for both cases: how it ends and how many records begin in it. These few numbers of
    each split, chained in the order of splits, say which case holds and how many records come before.
    A record of one line needs no shuffle; only lines of the others are gathered.
    """
    def walk(batches, emit):
        now, state, begun = None, [False, True], [0, 0]
        for b in batches:
            out = []
            for file, split, i, line in zip(*(c.to_pylist() for c in b.columns)):
                if (file, split) != now:
                    if now is not None and not emit:
                        out.append((*now, *state, *begun))
                    now, state, begun = (file, split), [False, True], [0, 0]
                begun = [n + (not s) for n, s in zip(begun, state)]
                before = state
                state = [quoted_after(line, s) for s in state] if '"' in line else state
                if emit:
                    out.append((file, split, i, line, *before, *state, *begun))
            if out:
                yield out
        if now is not None and not emit:
            yield [(*now, *state, *begun)]

    def both(emit, schema, names):
        def run(batches):
            for out in walk(batches, emit):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
        return _lines(spark, path).mapInArrow(run, schema)

    ends = both(False, "file string, split long, e0 boolean, e1 boolean, n0 long, n1 long", ["file", "split", "e0", "e1", "n0", "n1"])

    def chain(part):
        inside, base, rows = False, 0, []
        for x in part.sort_values("split").itertuples():
            rows.append((x.file, x.split, inside, base))
            inside, base = (x.e1, base + x.n1) if inside else (x.e0, base + x.n0)
        return pd.DataFrame(rows, columns=["file", "split", "inside", "base"])

    starts = written(ends.groupBy("file").applyInPandas(chain, "file string, split long, inside boolean, base long"), "splits")  # a row for each split
    every = both(True, "file string, split long, i long, line string, b0 boolean, b1 boolean, a0 boolean, a1 boolean, n0 long, n1 long", ["file", "split", "i", "line", "b0", "b1", "a0", "a1", "n0", "n1"])
    pick = lambda x: F.when(F.col("inside"), F.col(f"{x}1")).otherwise(F.col(f"{x}0"))
    met = every.join(starts.withColumnsRenamed({"file": "f", "split": "s"}), (F.col("file") == F.col("f")) & (F.col("split") == F.col("s"))).select(
        "file", "split", "i", "line", (F.col("base") + pick("n") - 1).alias("n"), (~pick("b") & ~pick("a")).alias("whole"))
    many = met.filter("not whole").groupBy("file", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "i", "line"))), lambda x: x["line"]), "\n").alias("record"))
    return met.filter("whole").select("file", "n", F.col("line").alias("record")).unionByName(many)


def _tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    opts = {"sep": "\t", "quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\u0001"}
    rows = records(spark, path).filter("record not in ('', '\r')").withColumn("record", F.regexp_replace("record", "\r$", ""))
    schema = ", ".join(f"{c} string" for c in columns)
    parsed = rows.select("n", F.from_csv("record", schema, opts).alias("c")).select("n", "c.*")
    head = parsed.filter("n = 0").select(columns).distinct().limit(2).collect()
    if [list(h) for h in head] != [columns]:
        raise ValueError(f"{path}: columns {[list(h) for h in head]}, expected {columns}")
    return parsed.filter("n > 0").select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """Four text columns; empty fields are empty strings; a repeated id is an error."""
    df = _tsv(spark, path, COLUMNS)
    if df.groupBy("entity_id").count().filter("count > 1").limit(1).count():
        raise ValueError(f"{path}: repeated entity_id")
    return df


def split_ids(c):
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """s1, ids."""
    df = _tsv(spark, path, ["source1_entity_id", "matched_entity_ids"])
    return df.select(F.col("source1_entity_id").alias("s1"), split_ids(F.col("matched_entity_ids")).alias("ids"))


def truth_pairs(truth: DataFrame) -> DataFrame:
    return truth.select("s1", F.explode("ids").alias("rid"))


def write_id_lists(s1: DataFrame, lists: DataFrame, path: str, name: str = "matched_entity_ids") -> None:
    """One row for each of s1 (position, s1) in order; ids (array) without repeats; empty field without any."""
    out = s1.join(lists, "s1", "left").select("position", F.col("s1").alias("source1_entity_id"), F.coalesce(F.array_join(F.array_distinct("ids"), ","), F.lit("")).alias(name))
    out.repartitionByRange("position").sortWithinPartitions("position").drop("position").write.mode("overwrite").options(sep="\t", header=True, emptyValue="", quote='"', escape='"').csv(path)


def aligned(a: DataFrame, b: DataFrame, keys=("ri", "si")) -> DataFrame:
    """Both tables' columns by key; an error if either has a key that the other lacks or a repeated one."""
    keys = list(keys)
    both = a.select(*keys).withColumn("__a", F.lit(1)).unionByName(b.select(*keys).withColumn("__a", F.lit(-1)))
    if both.groupBy(*keys).agg(F.sum("__a").alias("d"), F.count(F.lit(1)).alias("n")).filter("d <> 0 or n <> 2").limit(1).count():
        raise ValueError("the tables' keys differ")
    return a.join(b, keys)


def digest(df: DataFrame) -> str:
    """Of a table's rows, in any order."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{r.n}-{r.h}"


def fingerprint(**parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small settings file (a decision, a run's parameters) on any file system that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()


def read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


class StaleArtifact(Exception):
    """A table is there, but was made from other inputs."""


def step(spark: SparkSession, path: str, make, mark: str) -> DataFrame:
    """A table kept at `path`: made and written if missing, read if its mark agrees, refused otherwise, also if it has no mark."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path + ".meta.json")
    files = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(fs_path):
        had = read_json(spark, path + ".meta.json")["fingerprint"]
        if had != mark:
            raise StaleArtifact(path)
        return spark.read.parquet(path)
    if files.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        raise StaleArtifact(f"{path}: no mark tells what this was made from")
    make().write.parquet(path)
    write_json(spark, path + ".meta.json", {"fingerprint": mark})
    return spark.read.parquet(path)


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local master may go without one and gets one temporary folder."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("linkmill.tables.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        path = "file://" + tempfile.mkdtemp(prefix="linkmill-")
        spark.conf.set("linkmill.tables.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that only the steps of one job read; they are removed at the end of the block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{folder(spark)}/scratch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
