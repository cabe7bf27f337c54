"""Exact dedup by a tree-merge of sorted digest runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialise, salted_lookup, salts

#: Bits of a node's number that one round exchanges: 2 ** BITS runs are merged at a time.
BITS = 2
_ENTRY = "sha binary, xx long, bytes long, run int, best long, n long"


def merge_runs(batches):
    """Merges the runs of one node, which come sorted by digest: neighbours of one digest become one entry.

    The digests are compared as a whole (SHA-256, XXH64, length), the largest identifier and the
    sum of sizes stay. Only the last entry of a batch is held back, so memory is bounded by a batch.
    """
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([held, b] if held is not None else [b]).combine_chunks()
        sha = np.frombuffer(b"".join(t["sha"].to_pylist()), "V32")
        xx, size, best = t["xx"].to_numpy(), t["bytes"].to_numpy(), t["best"]
        new = np.r_[True, (sha[1:] != sha[:-1]) | (xx[1:] != xx[:-1]) | (size[1:] != size[:-1])]
        at = np.flatnonzero(new)
        known = best.is_valid().to_numpy()
        top = np.maximum.reduceat(np.where(known, best.fill_null(0).to_numpy(), np.iinfo(np.int64).min), at)
        some = np.logical_or.reduceat(known, at)
        out = pa.RecordBatch.from_arrays(
            [t["sha"].take(at).combine_chunks(), pa.array(xx[at]), pa.array(size[at]), t["run"].take(at).combine_chunks(), pa.array(top, pa.int64(), mask=~some), pa.array(np.add.reduceat(t["n"].to_numpy(), at))],
            schema=b.schema)
        held = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    if held is not None:
        yield held


def node(run: Column, bits: int, level: int) -> Column:
    """The node that holds an entry after `level` rounds: the digest's bits where rounds are done, the run's where not."""
    low = (1 << (BITS * level)) - 1
    return (F.col("xx").bitwiseAND(F.lit(low)).cast("int").bitwiseOR(run.bitwiseAND(F.lit(((1 << bits) - 1) & ~low)))).cast("int")


def exact_dedup(docs: DataFrame, keep: str = "max") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Each task makes one run of its rows, sorted by digest. In each round the nodes that differ in
    the next BITS bits of their number exchange their runs: an entry goes to the node whose bits
    there are those of its digest, which merges what it gets from 2 ** BITS nodes. After all
    rounds a digest is on one node only. Entries of one digest are merged before they are sent,
    so a text that holds a third of all rows is one entry for each run in the first round, and no
    node ever reads its rows. A digest is verified: SHA-256, XXH64 and byte length all agree.

    Null text counts as empty; very long texts are read once, for their digests. Ties: rows that
    share doc_id and text are one document, each is counted and returned with the same decision. A
    null doc_id is the smallest identifier. Empty table: empty result. Other columns are not read.
    keep: "max" keeps the largest doc_id of equal texts, "min" the smallest.
    """
    text, sign = F.coalesce(F.col("text"), F.lit("")), 1 if keep == "max" else -1
    rounds = 1
    while 1 << (BITS * rounds) < salts(docs):
        rounds += 1
    bits = BITS * rounds
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.xxhash64(text).alias("xx"), F.octet_length(text).cast("long").alias("bytes")), "digests")
    leaf = rows.select("sha", "xx", "bytes", F.spark_partition_id().bitwiseAND(F.lit((1 << bits) - 1)).alias("run"), (F.col("doc_id") * sign).alias("best"), F.lit(1).cast("long").alias("n"))
    with Scratch(docs.sparkSession) as work:
        runs = work.keep(leaf.sortWithinPartitions("sha", "xx", "bytes").mapInArrow(merge_runs, _ENTRY), "runs-0")
        for level in range(1, rounds + 1):
            dealt = runs.withColumn("run", node(F.col("run"), bits, level)).repartition(1 << bits, "run").sortWithinPartitions("run", "sha", "xx", "bytes")
            runs = dealt.mapInArrow(merge_runs, _ENTRY)
            runs = work.keep(runs, f"runs-{level}") if level < rounds else work.give(runs, "digest-groups")
    met = salted_lookup(rows, runs.select("sha", "xx", "bytes", "best", "n"), ["sha", "xx", "bytes"], "doc_id")
    best = F.col("best") * sign
    return met.select("doc_id", best.alias("keep_id"), F.col("n").alias("group_size"), F.coalesce(F.col("doc_id") == best, F.col("best").isNull()).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
