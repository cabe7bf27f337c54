"""Validation views and routing between models of seen and unseen countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decide import best_per_record


def leave_one_out(pairs: DataFrame) -> dict:
    """For each country its view of the pairs, with train: the rows of the other countries. The views are filters over one table, nothing is copied."""
    held = [r.country for r in pairs.select("country").distinct().orderBy("country").collect()]  # a row for each country
    return {c: pairs.withColumn("train", ~F.col("country").eqNullSafe(F.lit(c))) for c in held}


def view_sizes(pairs: DataFrame) -> DataFrame:
    """view, n, train of all views, from one count by country."""
    n = pairs.groupBy(F.col("country").alias("view")).agg(F.count(F.lit(1)).alias("own"))
    every = n.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("n"))  # one row
    return n.join(F.broadcast(every)).select("view", "n", (F.col("n") - F.col("own")).alias("train"))


def drop_masters(pairs: DataFrame, share: float = 0.19) -> DataFrame:
    """The pairs of the masters that stay when a hash takes away `share` of them: their records become ones without a master."""
    return pairs.filter(F.pmod(F.col("si") * F.lit(2246822519), F.lit(1 << 32)) % 1_000_000 >= int(share * 1e6))


def clones(best: DataFrame, truth: DataFrame, share: float, shift: int, p_min: float = 0.5) -> DataFrame:
    """Best pairs of p_min or more, and again the unmatched records that a hash draws, under new ids."""
    b = best.filter(F.col("p") >= p_min).select("ri", "si", "p")
    alone = b.join(truth, "ri", "left_anti").filter(F.pmod(F.col("ri") * F.lit(2654435761), F.lit(1 << 32)) % 1_000_000 < int(share * 1e6))
    return b.unionByName(alone.select((F.col("ri") + shift).alias("ri"), "si", "p"))


def route(seen_scores: DataFrame, unseen_scores: DataFrame, seen: DataFrame, seen_t: float, unseen_t: Column) -> DataFrame:
    """ri, si, p: pairs of seen countries by one model and a fixed threshold, others by another model and `unseen_t`.

    Both score tables have country, ri, si, p; the second may carry columns that `unseen_t` reads.
    The best master is chosen before the threshold, so a threshold never changes a record's owner.
    """
    a = best_per_record(seen_scores.join(F.broadcast(seen), "country", "left_semi")).filter(F.col("p") >= seen_t)
    u = unseen_scores.join(F.broadcast(seen), "country", "left_anti")
    b = best_per_record(u).join(u.drop("p"), ["ri", "si"]).filter(F.col("p") >= unseen_t)
    return a.select("ri", "si", "p").unionByName(b.select("ri", "si", "p"))
