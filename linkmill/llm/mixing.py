"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

#: Weights by the source's place, repeating; share of all words to take; most epochs of a source.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
#: Buckets of the sampling key in each source; only the bucket at the budget's end is sorted.
BUCKETS = 4096
#: Smallest weight of a document.
LEAST = 0.25


def targets(sizes: DataFrame) -> DataFrame:
    """Target words of each source: a fill by weight that stops at EPOCHS times a source's size.

    sizes: source, source_size. The capped sources are those of the smallest size for their
    weight; the level of the others follows from the running sums, which gives the same
    targets as resharing the excess until none is above. One row for each source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    before = Window.orderBy("__ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sizes.withColumn("__place", place).withColumn("__w", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("__place") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    s = s.withColumn("__cap", F.col("source_size") * F.lit(float(EPOCHS))).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    s = s.withColumn("__level", (F.sum("source_size").over(all_rows) * F.lit(SHARE) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
                     / (F.sum("__w").over(all_rows) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))))
    s = s.withColumn("__fill", F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__place", "__level"))).over(all_rows)["__level"])
    return s.select("source", "source_size", F.least("__cap", F.coalesce("__fill", F.lit(0.0)) * F.col("__w")).alias("target"))


def quality_weight(text):
    """Weight LEAST to 1: the share of a whole text's characters that are letters, of any script."""
    letters = F.length(text) - F.length(F.regexp_replace(text, r"\p{L}", ""))
    return F.lit(LEAST) + F.lit(1 - LEAST) * letters / F.greatest(F.length(text), F.lit(1))


def sampling_key(text):
    """-ln(u) / weight; u is a hash of doc_id and the text."""
    unit = (F.pmod(F.xxhash64(F.col("doc_id"), text), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return -F.log(unit) / quality_weight(text)


def mix(docs: DataFrame, buckets: int = BUCKETS, with_hash: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row; with_hash: and text_hash.

    A source first gives whole epochs (each document once), then documents in the order of
    their key -ln(u) / weight until the budget is filled; the last one counts in part. u is a
    hash of doc_id and the text, so reruns agree. The key's buckets are summed first, and only
    the rows of the bucket in which the budget ends are sorted: no task sorts a source.

    Null text has size 0 and takes 0; very long texts are counted whole. A null source is a source of its own, last; a
    null doc_id is one like any other. Equal keys (repeated rows) are taken in any order with equal
    sums. Empty table: empty result. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", F.col("source").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        sampling_key(text).alias("__key"), F.xxhash64("text").alias("text_hash"),
    # At rate LEAST no bucket holds more than 1 / LEAST times its share of a source, whatever the weights.
    ).withColumn("__b", F.floor((1 - F.exp(-F.col("__key") * LEAST)) * buckets).cast("int"))
    rows = materialise(rows, "mix")  # texts are read once
    sums = rows.groupBy("source", "__b").agg(F.sum("size").alias("__sum"))
    goal = targets(sums.groupBy("source").agg(F.sum("__sum").alias("source_size")))
    goal = goal.withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goal = goal.withColumn("__rest", F.round(F.col("target") - F.col("__epochs") * F.col("source_size")).cast("long"))
    upto = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    plan = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(upto), F.lit(0)))
    plan = plan.alias("p").join(goal.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select(
        F.col("p.source").alias("__s"), F.col("p.__b").alias("__pb"), "source_size", "target", "__epochs",
        F.when(F.col("__before") + F.col("__sum") <= F.col("__rest"), 1).when(F.col("__before") >= F.col("__rest"), 0).otherwise(2).alias("__how"),
        (F.col("__rest") - F.col("__before")).alias("__left"))
    got = rows.join(plan, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__pb")))
    order = Window.partitionBy("source", "__b").orderBy("__key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = got.filter("__how = 2").withColumn("__part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("__left") - F.coalesce(F.sum("size").over(order), F.lit(0)))))
    whole = got.filter("__how <> 2").withColumn("__part", F.when(F.col("__how") == 1, F.col("size")).otherwise(F.lit(0)))
    return whole.unionByName(edge).select(
        "doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"),
        (F.col("__epochs") * F.col("size") + F.col("__part")).cast("long").alias("taken"), *["text_hash"] * with_hash)


def repeated(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them: once for each whole epoch, and a part counts from one half on.

    Rows that repeat doc_id, source and text share their copies evenly, rounded. Null texts and texts
    without words are not taken; very long ones count whole. A null doc_id or source is one like any other. Empty table: empty result.
    """
    times = F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))
    taken = mix(docs, with_hash=True).groupBy(F.col("doc_id").alias("id"), F.col("source").alias("of"), "text_hash").agg(F.round(F.avg(times)).cast("int").alias("times")).filter("times > 0")
    held = docs.select(F.struct(*docs.columns).alias("d"), F.col("doc_id").alias("did"), F.col("source").alias("src"), F.xxhash64("text").alias("h"))
    met = held.join(taken.hint("shuffle_hash"), F.col("did").eqNullSafe(F.col("id")) & F.col("src").eqNullSafe(F.col("of")) & (F.col("h") == F.col("text_hash")))
    return met.withColumn("copy", F.explode(F.expr("sequence(1, times)"))).select([F.col("d")[c].alias(c) for c in docs.columns])
