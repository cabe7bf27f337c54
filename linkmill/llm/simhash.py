"""SimHash near-dedup with pigeonring candidate filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, salted_lookup

#: Segments on the ring, bits of each, and differing bits allowed.
SEGMENTS, BITS, DIFFER = 8, 8, 2
#: Segments of a chain that must agree wholly: those whose share of DIFFER is under one.
WHOLE = (SEGMENTS - 1) // DIFFER
#: Larger buckets are linked through midpoints, not pair by pair.
PAIRS_UP_TO = 64


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' XXH64. No word: zero."""
    words = text.lower().split()  # for bytes: A-Z only, the six ASCII white-space characters only
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(flat, seed)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = (end - size + 1)[: 1 - shingle].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[a:b], seed) for a, b in zip(start, end[shingle - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, xx (a hash of the text), fp (the 64 bits as a signed long). Null text has no word."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp, pa.int64())], ["doc_id", "xx", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("t"), F.xxhash64("text").alias("xx")).mapInArrow(run, "doc_id long, xx long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints that keep every component whole.

    Pigeonring: if two fingerprints differ in at most DIFFER bits, some chain round the ring has,
    at every length l, at most l * DIFFER / SEGMENTS differing bits. The first WHOLE segments of
    such a chain agree; they are the join key. The chain's later budgets and the full distance
    are part of the join's condition, so only links are emitted. In a bucket of over PAIRS_UP_TO,
    each member meets the others at the fingerprints one bit away: those at one midpoint
    (41 at most) are all within two bits, and link to their smallest. No link is lost.
    """
    key_bits = WHOLE * BITS
    rest_bits = 64 - key_bits
    turned = fps.select("fp", F.explode(F.expr(f"sequence(0, {SEGMENTS - 1})")).alias("i")).withColumn(
        "r", F.when(F.col("i") == 0, F.col("fp")).otherwise(F.expr(f"shiftrightunsigned(fp, i * {BITS}) | shiftleft(fp, 64 - i * {BITS})")))
    cells = turned.select("fp", "i", F.expr(f"r & {(1 << key_bits) - 1}L").alias("k"), F.expr(f"shiftrightunsigned(r, {key_bits})").alias("rest"))
    cells = materialise(cells, "simhash-turned")
    counts = cells.groupBy("i", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = materialise(salted_lookup(cells, counts, ["i", "k"], "fp").filter("n > 1"), "simhash-cells")
    small = met.filter(f"n <= {PAIRS_UP_TO}")
    budgets = " and ".join(f"bit_count((x.rest ^ y.rest) & {(1 << (n * BITS - key_bits)) - 1}L) <= {n * DIFFER // SEGMENTS}" for n in range(WHOLE + 1, SEGMENTS + 1))
    pairs = small.alias("x").join(small.alias("y"), F.expr(f"x.i = y.i and x.k = y.k and x.fp < y.fp and {budgets}")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    at = met.filter(f"n > {PAIRS_UP_TO}").select("fp", "i", "k", F.explode(F.expr(f"concat(array(rest), transform(sequence(0, {rest_bits - 1}), j -> rest ^ shiftleft(1L, j)))")).alias("mid"))
    star = at.groupBy("i", "k", "mid").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).select("a", F.explode("all").alias("b")).filter("a < b")
    return pairs.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it reaches) by alternating large and small stars.

    Each round is written to the shared folder. A hub's rows are split by the other end.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        met = salted_lookup(both, low, "a", "b")
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    edges = materialise(edges, "components")
    mark = None
    while True:
        edges = materialise(star(star(edges, True), False), "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of docs, and fp, low, root: the smallest doc_id of each fingerprint and the smallest fingerprint that it reaches."""
    rows = materialise(fingerprints(docs), "simhash")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(first.select("fp")))
    return rows, first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    component_id is the smallest doc_id reachable over links of DIFFER bits or fewer. Copies are
    gathered into one fingerprint first. Null or empty text has fingerprint zero and links like
    any other; short texts are one shingle, very long ones are read whole; repeated rows are returned
    as often as they come; an empty table gives an empty result;
    a null doc_id never names a component while another is there. Other columns are not read.
    """
    rows, named = classes(docs)
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    table = salted_lookup(named.select("fp", "root"), lowest, "root", "fp").select("fp", "component_id")
    return salted_lookup(rows, table, "fp", "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs of each group of near copies, with all its columns: that of the smallest doc_id (null is the largest), of the smallest text hash then; of rows that repeat both any one.

    The rest as near_dedup has it: null and empty texts are one group, very long ones are read whole, an empty table gives no row.
    """
    rows, named = classes(docs)
    least = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "xx")).alias("row"))
    chosen = named.select("fp", "root").join(least, "fp").groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.doc_id").alias("id"), F.col("row.xx").alias("xx"))
    held = docs.select(F.struct(*docs.columns).alias("d"), F.col("doc_id").alias("did"), F.xxhash64("text").alias("h"))
    met = held.join(chosen.hint("shuffle_hash"), F.col("did").eqNullSafe(F.col("id")) & (F.col("h") == F.col("xx")))
    one = Window.partitionBy("did", "h").orderBy("h")  # takes the first row that comes, before rows are sent
    return met.withColumn("o", F.row_number().over(one)).filter("o = 1").select([F.col("d")[c].alias(c) for c in docs.columns])
