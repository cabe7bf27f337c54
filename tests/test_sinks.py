import json
import random

import pytest
from pyspark.sql import functions as F

from linkmill.operators import views
from linkmill.sources import sinks, tables


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    made, path = [], str(tmp_path / "parts")

    def make(stop):
        def one(part):
            made.append(part)
            if part == stop:
                raise RuntimeError("stopped")
            return spark.range(3).select(F.concat(F.lit(part), F.col("id")).alias("v"), F.lit(part).alias("country"))
        return one

    parts = ["no", "is/land 5%", "", "fo"]
    with pytest.raises(RuntimeError):
        sinks.committed_parts(spark, path, "country", parts, make("fo"), "m")
    rows = sinks.committed_parts(spark, path, "country", parts, make(None), "m").collect()
    assert made == ["no", "is/land 5%", "", "fo", "fo"]
    assert sorted((r.country, r.v) for r in rows) == sorted((p, f"{p}{i}") for p in parts for i in range(3))
    (tmp_path / "parts" / "marks" / "p-no.json").unlink()  # without its mark a part does not count
    assert sinks.committed_parts(spark, path, "country", parts, make(None), "m").count() == 12 and made[-1] == "no"
    with pytest.raises(tables.StaleArtifact):
        sinks.committed_parts(spark, path, "country", parts, make(None), "other")


def test_publish_only_what_passes(spark, tmp_path):
    path, log = str(tmp_path / "out"), str(tmp_path / "log")
    metrics = {"n": F.count(F.lit(1)), "top": F.max("id")}
    assert sinks.publish(spark.range(10), path, metrics, {"n": lambda n: n > 5}, log) == {"n": 10, "top": 9}
    with pytest.raises(ValueError, match="top = 2"):
        sinks.publish(spark.range(3), path, metrics, {"top": lambda t: t > 5}, log)
    assert spark.read.parquet(path).count() == 10 and sorted(p.name for p in tmp_path.iterdir()) == ["log", "out"]
    sinks.publish(spark.range(7), path, metrics, {})
    assert spark.read.parquet(path).count() == 7
    said = sorted((json.loads(p.read_text()) for p in (tmp_path / "log").glob("*.json")), key=lambda r: -r["metrics"]["n"])
    assert [r["failed"] for r in said] == [[], ["top"]]


def test_subsets_in_one_scan(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i) for i in range(40)], "i long, v long")
    sinks.write_subsets(df, {"even": F.col("i") % 2 == 0, "low": F.col("v") < 9, "none": F.lit(False)}, path)
    got = {n: sorted(r.i for r in sinks.subset(spark, path, n).collect()) for n in ("even", "low", "none")}
    assert got == {"even": list(range(0, 40, 2)), "low": [i for i in range(9) if i % 5], "none": []}
    assert "PartitionFilters: [isnotnull(subset" in sinks.subset(spark, path, "low")._jdf.queryExecution().executedPlan().toString()


def test_stored_columns_join_without_a_shuffle(spark, tmp_path):
    names = [f"cols_{tmp_path.name}_{i}".replace("-", "_") for i in range(3)]
    try:
        for i, n in enumerate(names):
            sinks.store_columns(spark.range(200).select(F.col("id").alias("ri"), (F.col("id") % 7).alias("si"), (F.col("id") * i).alias(f"f{i}")).repartition(5), n, buckets=4)
        got = sinks.stored_columns(spark, names)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == [(i, i % 7, 0, i, 2 * i) for i in range(200)]
    finally:
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_predicates_of_text(spark):
    df = spark.range(10).withColumn("country", F.lit("no"))
    assert sinks.where(df, "id > 6 and country = 'no'").count() == 3 and sinks.where(df, " ").count() == 10
    for bad in ("nothing > 1", "id >", "id + 1"):
        with pytest.raises(ValueError, match="country"):
            sinks.where(df, bad)


def test_batches_of_alike_lengths(spark):
    r = random.Random(2)
    rows = [(i, None if i % 50 == 0 else "x" * r.choice([1, 5, 30, r.randrange(300), 5000])) for i in range(600)]
    got = sinks.length_batches(spark.createDataFrame(rows, "i long, t string").repartition(5), "t", 2000).collect()
    assert sorted(x.i for x in got) == list(range(600))
    by = {}
    for x in got:
        by.setdefault(x.batch, []).append(len(x.t or ""))
    assert all(max(v) * len(v) <= 2000 or len(v) == 1 for v in by.values())
    assert sum(max(v) * len(v) for v in by.values()) < 1.3 * sum(map(sum, by.values())) + 8 * 2000


def test_leave_one_out_copies_nothing(spark):
    pairs = spark.createDataFrame([(1, "no"), (2, "is"), (3, None), (4, "no")], "ri long, country string")
    got = {c: sorted((x.ri, x.train) for x in v.collect()) for c, v in views.leave_one_out(pairs).items()}
    assert got["no"] == [(1, False), (2, True), (3, True), (4, False)] and set(got) == {"no", "is", None}
    assert got[None] == [(1, True), (2, True), (3, False), (4, True)]
